"""Where records come from and go to: runs, manifests, logs, dictionaries and workloads."""
