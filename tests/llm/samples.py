"""Texts that are awkward for tokenizers."""

ODD = [
    None, "", " ", "a", " lead", "trail ", "two  spaces", "tab\tand\nline\r\n", "▁marker ▁ in text", "Ünï·code x’s don't 12,3 á ́b ǅ ﬁ É, ß. İ", "　wide　space x\x1cz",
    "日本語 のテキスト 😀 👩‍👩‍👧", "½ a'll I'M", "<s> </s> <unk> <0x0A>", "x" * 3000, "word. " * 40_000, "été," * 5, "\x00 \x01\x02", "Word word WORD word. word, Word.,", "ÀÖØ öøÿ ×÷ ẞ ŉ",
]
SCHEMA = "doc_id long, text string, ids string, start int"


def rows():
    out = [(i * 7 % 23, t, "x", 1) for i, t in enumerate(ODD)]
    return [*out, (None, "no id", "x", 1), (5, "repeated row", "x", 1), (5, "repeated row", "x", 1)]
