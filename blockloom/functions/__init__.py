"""Part of blockloom."""
