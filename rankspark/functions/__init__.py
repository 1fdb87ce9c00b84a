"""Column expressions: everything here stays inside Catalyst, no Python runs on executors."""
