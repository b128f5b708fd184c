"""Physical building blocks and relational operators."""
