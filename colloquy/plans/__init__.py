"""End-to-end plans: lazy compositions, and runs that write tables between stages."""
