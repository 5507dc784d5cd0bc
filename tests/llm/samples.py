"""What the tests of this folder share."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def letters(text):
    """``text`` with letters for digits."""
    return text.translate(str.maketrans("0123456789", "cdefghijkl"))
