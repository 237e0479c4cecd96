"""The expression language: parse, compile to Spark columns, evaluate."""

from .compile import Context, Registry, Typed, apply, compile_text, evaluate, evaluate_as, evaluate_boolean, evaluate_empty, evaluate_float, evaluate_int, evaluate_number, evaluate_string, evaluate_tuple
from .syntax import Node, parse

__all__ = ["Context", "Node", "Registry", "Typed", "apply", "compile_text", "evaluate", "evaluate_as", "evaluate_boolean", "evaluate_empty", "evaluate_float", "evaluate_int", "evaluate_number", "evaluate_string", "evaluate_tuple", "parse"]
