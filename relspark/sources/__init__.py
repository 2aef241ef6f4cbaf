"""Where rows come from and go to: the catalog of typed tables, and plain files."""
