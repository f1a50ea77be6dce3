"""See the package README section for `functions`."""
