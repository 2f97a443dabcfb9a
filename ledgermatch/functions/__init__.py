"""Column expressions: text aggregates, code clean-up, canonical values."""
