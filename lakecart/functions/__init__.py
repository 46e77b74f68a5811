"""Column-level building blocks (pure expressions; everything stays in whole-stage codegen)."""
