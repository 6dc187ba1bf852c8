"""Column factories (pure expressions, stay inside whole-stage codegen)."""
