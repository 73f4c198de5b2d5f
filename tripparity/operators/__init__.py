"""Table operators: contracts, feature transforms, faults, parity, drift, metrics, models, SHAP."""
