"""trustlake: trust analytics for registries of machine-learning artifacts."""
