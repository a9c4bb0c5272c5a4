"""Multi-fidelity regression and paired experiment analytics as Spark DataFrame operators."""
