"""Ten edges that meet every corner of the rules, and what each query finds in them, as lists of seq."""

_ENDS = [
    ("joy", "faith", "Joy#1", "Faith#1", 1, "eitza"),
    ("faith", "joy", "Faith#2", "Joy#2", 1, "bechina"),
    ("joy", "joyful song", "Joy#3", "Song", 2, "bechina"),
    ("joy", "faith", "Joy#4", "Faith#3", 2, "eitza"),
    ("humility", "humility", "Hum#1", "Hum#2", 10, "bechina"),
    ('the "king"', "joy", "King", "Joy#5", 10, "eitza"),
    ("a.b", "axb", "AB", "AXB", 2, "bechina"),
    (None, "joy", None, "Joy#6", 3, "eitza"),
    ("faith", None, "Faith#4", None, None, "bechina"),
    ("joy", "peace", "", "Peace", 1, "other"),
]


def english(text):
    return f"en:{text}" if text else None


ROWS = [
    (seq, a, b, ta, tb, f"p{seq}", ref, kind, None, 1 if seq == 2 else None, english(ta), english(tb))
    for seq, (a, b, ta, tb, ref, kind) in enumerate(_ENDS)
]

LIVE = {
    "joy": ([5, 7], [0, 3], [1, 2], [0, 1, 2, 3, 5, 7, 9]),
    "a.b": ([], [], [6], [6]),
    "null": ([], [], [], []),
    'the "king"': ([], [5], [], [5]),
}
MODULE = {
    "joy": ([5, 7], [0, 3], [2, 1, 2], [0, 3, 5, 7, 2, 1, 2]),
    "^joy$": ([5, 7], [0, 3], [2, 1], [0, 3, 5, 7, 2, 1]),
    "a.b": ([], [], [6, 6], [6, 6]),
    "null": ([], [7], [8], [7, 8]),
    'the "king"': ([], [5], [], [5]),
    "": ([], [], [], []),
}
NAMES = ("advice", "effects", "aspects", "connected")
REFERENCES = {1: ([0, 1, 9], [0, 1]), 2: ([2, 3, 6], [3, 2, 6]), 10: ([4, 5], [5, 4])}
