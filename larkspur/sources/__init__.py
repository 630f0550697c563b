"""Where tables come from: registered Parquet folders and the snapshot catalog."""
