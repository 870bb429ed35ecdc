"""Number tokens of printed tables, as regular expressions."""

_EXPONENT = r"(?:[Ee][-+]?\d+)?"
REAL = r"[-+]?(?:\d+\.\d*|\.\d+)" + _EXPONENT              # with a decimal point
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)" + _EXPONENT       # with or without one


def row_of(count: int, token: str = REAL) -> str:
    """``count`` numbers, each a group, with white space before each."""
    return rf"\s+({token})" * count


def labelled(label: str, count: int, token: str = NUMBER) -> str:
    """A label and the ``count`` numbers after it, each a group."""
    return label + r"\s*" + r"\s+".join([f"({token})"] * count)
