"""Part of silkmoth; see README.md."""
