"""Pieces of a text are looked up once where they are known."""
from courtside.llm.pretokens import Memory, TextEncoder

PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counting(Memory):
    def __init__(self, limit):
        super().__init__(limit)
        self.asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


def _encoder():
    e = TextEncoder(lambda tokens: [t.encode() + b"|" for t in tokens], PATTERN)
    e.pieces = Counting(1000)
    return e


def test_known_pieces_are_looked_up_once():
    e = _encoder()
    text = "one two three two it's 4th"
    first = e([text])
    e.pieces.asked = 0
    assert e([text]) == first
    assert e.pieces.asked == 5


def test_same_ids_whatever_is_known():
    import regex
    texts = ["one two", "a  b", "x\ty z", " lead", "", "tail ", "one two3 \u0251a", "a b\n c", "one", "\u00f1u \u0251\u0251 it's"]
    plain = [b"".join(t.encode() + b"|" for t in regex.findall(PATTERN, x)) for x in texts]
    e = _encoder()
    assert e(texts) == plain and e(texts) == plain and e(texts[::-1]) == plain[::-1]
