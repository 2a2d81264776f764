"""Where rows go: files, load plans, and the statements that other systems load them with."""
