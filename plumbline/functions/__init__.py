"""Column expressions: reference scores, feature bases, scalar helpers, the distribution of Student's t."""
