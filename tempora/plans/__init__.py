"""Plan helpers: shared materialisation, size-checked broadcasts, salting."""
