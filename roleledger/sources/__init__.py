"""Reading and writing of master files, key lists, snapshots, landed pages and run state."""
