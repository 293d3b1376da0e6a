"""Planning and running record programs."""
