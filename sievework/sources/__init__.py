"""Where rows come from and go to: image folders, the embedding cache, phase tables, files."""
