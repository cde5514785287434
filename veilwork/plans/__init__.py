"""Jobs built from the operators: classification, policy, risk, validation, audit, reports."""
