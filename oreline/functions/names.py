"""Short identifiers that are not ambiguous, and words that JavaScript reserves."""

SHORT_NAMES = frozenset("_ i j k x y z id ok db fs io ui api url uri ip os re rx tx err req res ctx".split())
RESERVED = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null package private protected public return static super switch this throw true try typeof var void while with yield".split()
)


def is_ambiguous(name: str, reserved: frozenset[str] = frozenset()) -> bool:
    return len(name) <= 2 and name not in SHORT_NAMES and name not in reserved
