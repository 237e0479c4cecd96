"""Built-in scalar functions of the expression language."""
