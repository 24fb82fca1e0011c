"""Readers of vaults, exports and logs, and writers of what the engine keeps."""
