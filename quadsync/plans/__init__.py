"""Jobs composed from the operators: healing, live flow, publishing."""
