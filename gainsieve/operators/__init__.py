"""DataFrame operators: ranking, sampling, scaling, selection, folds."""
