"""The jobs: scoring, loads, snapshots, changes and reports."""
