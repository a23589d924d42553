"""Options and the jobs that put operators together."""
