"""Column-level building blocks: hashing, text rules, tag grammar, fixed values, wording."""
