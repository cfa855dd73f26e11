"""Every registered query beside the independent SQL that must give the same rows."""
