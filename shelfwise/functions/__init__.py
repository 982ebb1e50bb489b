"""Column expressions. Nothing in here touches a DataFrame or the session."""
