"""What can go wrong in an expression. Every class is an ExpressionError."""

from __future__ import annotations


class ExpressionError(ValueError):
    """Base of all errors of the expression language."""


def _kind(name: str, doc: str) -> type[ExpressionError]:
    return type(name, (ExpressionError,), {"__doc__": doc, "__module__": __name__})


#: The kinds of errors.
WrongOperatorArgumentAmount = _kind("WrongOperatorArgumentAmount", "An operator has too few or too many operands.")
WrongFunctionArgumentAmount = _kind("WrongFunctionArgumentAmount", "A function has too few or too many arguments.")
ExpectedString = _kind("ExpectedString", "Something else than a string.")
ExpectedInt = _kind("ExpectedInt", "Something else than an int.")
ExpectedFloat = _kind("ExpectedFloat", "Something else than a float.")
ExpectedNumber = _kind("ExpectedNumber", "Something else than a number.")
ExpectedNumberOrString = _kind("ExpectedNumberOrString", "Something else than a number or a string.")
ExpectedBoolean = _kind("ExpectedBoolean", "Something else than a boolean.")
ExpectedTuple = _kind("ExpectedTuple", "Something else than a tuple.")
ExpectedFixedLenTuple = _kind("ExpectedFixedLenTuple", "A tuple of another length.")
ExpectedEmpty = _kind("ExpectedEmpty", "Something else than the empty value.")
AppendedToLeafNode = _kind("AppendedToLeafNode", "Two values without an operator between them.")
PrecedenceViolation = _kind("PrecedenceViolation", "An operator where none can stand.")
VariableIdentifierNotFound = _kind("VariableIdentifierNotFound", "No variable or column has this name.")
FunctionIdentifierNotFound = _kind("FunctionIdentifierNotFound", "No function has this name.")
TypeError_ = _kind("TypeError_", "A value of a type that does not serve here.")
WrongTypeCombination = _kind("WrongTypeCombination", "An operator does not combine these types.")
UnmatchedLBrace = _kind("UnmatchedLBrace", "A left brace without its right one.")
UnmatchedRBrace = _kind("UnmatchedRBrace", "A right brace without its left one.")
MissingOperatorOutsideOfBrace = _kind("MissingOperatorOutsideOfBrace", "A brace next to a value without an operator.")
UnmatchedPartialToken = _kind("UnmatchedPartialToken", "A sign that only exists as a part of a longer one.")
AdditionError = _kind("AdditionError", "An addition overflows.")
SubtractionError = _kind("SubtractionError", "A subtraction overflows.")
NegationError = _kind("NegationError", "A negation overflows.")
MultiplicationError = _kind("MultiplicationError", "A multiplication overflows.")
DivisionError = _kind("DivisionError", "A division overflows or divides by zero.")
ModulationError = _kind("ModulationError", "A remainder overflows or divides by zero.")
InvalidRegex = _kind("InvalidRegex", "A pattern that cannot be compiled.")
ContextNotMutable = _kind("ContextNotMutable", "An assignment where none is allowed.")
IllegalEscapeSequence = _kind("IllegalEscapeSequence", "A backslash before something else than a quote or a backslash.")
CustomMessage = _kind("CustomMessage", "An error of a user's function.")
