"""The analytics a user calls, one module per subject."""
