"""Recovery scoring as Spark jobs: every submission against all ground truth in one plan."""
