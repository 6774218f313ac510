"""Column functions: name sets, scalar rules, rules for trace lines."""
