"""Folds, preprocessing, regressors, ensembles and importances on DataFrames."""
