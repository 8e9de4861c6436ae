"""Submit-able linkage jobs: each builds one crosswalk file."""
