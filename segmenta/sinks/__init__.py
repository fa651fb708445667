"""Writing units: new files, and originals with their targets put in."""
