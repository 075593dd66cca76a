"""Part of tidepool; see README.md."""
