"""Jobs composed of several operators: model studies and re-training."""
