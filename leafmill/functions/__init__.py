"""Column functions: Column to Column, inside code generation, no Python workers."""
