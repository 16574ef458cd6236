"""Reading and writing recordings, stores, logs, run results and manifests."""
