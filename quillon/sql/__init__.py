"""The SQL dialect: text to statements."""
