"""Column functions: built-in expressions that stay inside whole-stage codegen."""
