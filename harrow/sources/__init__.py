"""Sources of files and pages."""
