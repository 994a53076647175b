"""Where rows come from and go to: export files, their specs, written tables."""
