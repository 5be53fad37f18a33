"""Parameters the registered queries and their SQL share."""

N_FEATURES = 1000
SMOOTHING = 0.1
SEED = 42
EPOCHS = 3
MIN_IMPROVEMENT = 1e-5
UNLABELED_WEIGHT = 0.5
DIRICHLET_ALPHA = 0.5
WINDOW = (2, 3)
SWEEP_SIZES = (100, 200, 400, 800)
SWEEP_BASE = 1000
GRID_SIZES = (1, 2, 4, 8, 16)
GRID_TRIALS = 3
GRID_EPOCHS = 2
COMPARE_SIZES = (1, 4, 16, 64)
LABEL_SHARES = (0.7, 0.8, 0.9)
STRATA_FRACTIONS = {0: 0.5, 1: 0.1}
RANDOM_SIZES = (10, 40, 160, 640)
RANDOM_TRIALS = 3
SHARE_TRIALS = 3
