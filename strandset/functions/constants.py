"""Fixed values that results depend on."""

# Month names in calendar order.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)

# Nationality words and the countries they stand for.
DEMONYMS = {
    "american": "united states",
    "british": "united kingdom",
    "english": "united kingdom",
    "scottish": "united kingdom",
    "welsh": "united kingdom",
    "french": "france",
    "german": "germany",
    "italian": "italy",
    "spanish": "spain",
    "canadian": "canada",
    "australian": "australia",
    "indian": "india",
    "japanese": "japan",
    "chinese": "china",
    "russian": "russia",
    "croatian": "croatia",
    "czech": "czech republic",
    "ugandan": "uganda",
    "malaysian": "malaysia",
}

# Words of a question that ask for the largest or the smallest value.
MAXIMUM_CUES = (
    "younger", "youngest", "later", "latest", "newer", "newest", "more ", "most ", "larger", "largest", "longer", "longest", "higher", "highest", "greater",
)
MINIMUM_CUES = (
    "older", "oldest", "earlier", "earliest", "first", "less ", "fewer", "smaller", "smallest", "shorter", "shortest", "lower", "lowest",
)

# Answer operators, and those whose valid results are certified.
GROUNDED = ("copy", "argmin", "argmax", "equal", "common")
SEMANTICS = "strandset-vm-1"

# Words that don't identify a title by themselves.
GENERIC_TITLE_WORDS = (
    "the", "a", "an", "of", "in", "on", "for", "and", "film", "song", "album", "team", "season", "school", "university", "college", "episode", "series",
)

# Phrases of a question that compares.
COMPARISON_PHRASES = (
    "which is older", "which was earlier", "which is larger", "which is longer", "who was born first", "are both", "same nationality", "younger", "older", "which came first", "who came first", "won more",
)

# Fixed value: what a word of a title is.
TITLE_WORD = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"

# Fixed value: a closing parenthesis of a title.
CLOSING_PARENTHESIS = r"\s*\([^)]*\)\s*$"

# Marks around the digest that replaces a text, tried in this order.
REPLACEMENT_MARKS = ("§", "¤", "※", "⌁", "◊", "☷")

# Wiki markup, in the order that it goes, and what stands in its place.
WIKI_MARKUP = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<ref\b[^>]*>.*?</ref>", " "),
    (r"<[^>]+>", " "),
    (r"\[\[(?:[^\]|]*\|)?([^\]]+)\]\]", "$1"),
    (r"\{\{[^{}]*\}\}", " "),
    (r"'{2,}", ""),
)

# Numbers that are edited downwards (days that end a month, the last year read as one); all others go up.
EDITED_DOWN = (29, 30, 31, 2099)
