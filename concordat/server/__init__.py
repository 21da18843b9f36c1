"""Driver-side services: jobs and a read-only HTTP interface."""
