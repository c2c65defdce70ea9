"""Ready-made plans over the operators, and the registered queries."""
