"""Training-data operators: corpus jobs, each in its own module, and their registered queries."""
