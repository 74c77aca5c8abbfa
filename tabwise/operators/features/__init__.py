"""Feature engineering Estimators / Models."""
