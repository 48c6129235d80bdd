"""Word lists, patterns and limits that results depend on."""

# Words that carry no topic.
STOPWORDS = (
    "about", "after", "also", "and", "are", "can", "for", "from", "has", "have", "how", "into", "its", "our", "should",
    "that", "the", "their", "this", "was", "what", "when", "where", "which", "who", "why", "with",
)
WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"

# Lines that are no content, matched as a whole; the first kind that matches counts.
BOILERPLATE = (
    ("email_signature", r"(?i)^sent from my (iphone|ipad|ipod|android|samsung|galaxy|mobile device|mobile|blackberry|huawei|pixel)\b.*$"),
    ("page_marker", r"(?i)^page\s+\d+(\s+of\s+\d+)?$"),
    ("email_reply_header", r"(?i)^on .+ wrote:$"),
    ("decorative_rule", r"^(----+|====+|____+|\*\*\*\*+|~~~~+)$"),
)

# Function words that tell a language.
LANGUAGE_MARKERS = {
    "pt": (
        "nao", "não", "são", "sao", "cerca", "porque", "tambem", "também", "muito", "qual", "quando", "onde", "entre", "sobre",
        "ainda", "depois", "cada", "pode", "ser", "estar", "é", "em", "até", "você", "voce", "uma", "às", "pelo", "pela",
        "pelos", "pelas", "isso", "isto", "exceto", "estão", "nós", "num", "numa",
    ),
    "es": ("para", "pero", "porque", "tambien", "cuando", "donde", "entre", "sobre", "muy", "cada"),
    "fr": ("pour", "mais", "parce", "quand", "dont", "entre", "sur", "tres", "très", "avec", "chaque"),
    "de": ("und", "nicht", "auch", "wenn", "wo", "zwischen", "uber", "über", "sehr", "jede", "sein"),
}

# Cues for relations between passages.
REVERSAL = r"scratch that|on second thought|changed (?:my|our) minds?|change of plans?|mudei de ideia|mudamos de ideia|pensando melhor|esquece isso|em vez de|ao inv[eé]s de"
SUPERSESSION = r"(?i)\b(?:revised|revision|superseded|supersedes|corrected|correction|amended|amendment|restated|restatement|down from|up from|" + REVERSAL + r"|deprecated|supersede)\b"
QUALIFIER = r"(?i)\b(except|exception|unless|however|but |although|though|nevertheless|for payment|for .* requests?,|normally|generally|in general)\b"
NEGATION = r"(?i)\b(not|no\b|never|n't\b|without|forbidden|prohibited|must not|do not|don't|cannot|can't)\b"

# Instructions and quotations inside data.
INSTRUCTION = (
    r"(?i)\b(?:ignore|disregard|forget|override)\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)?\s*(?:instructions?|directions?|rules?)\b"
    r"|\b(?:you\s+are\s+now|reveal\s+the\s+system\s+prompt|delete\s+the\s+user\s+account)\b"
)
STANDALONE_INSTRUCTION = (
    r"(?is)^\s*(?:ignore|disregard|forget|override)\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)?\s*(?:instructions?|directions?|rules?)\b"
    r"|^\s*you\s+are\s+now\b.*\b(?:reveal|delete|send|execute|disable|secrets?|configuration)\b"
)
QUOTED_SPEECH = r"(?i)[“\"'][^\"“”]{12,}[”\"']|\b(?:wrote|said|reported|stated|asked|complained|replied)\b[^.]{0,40}:"

# Tools and limits of the transcript rules.
EDIT_TOOLS = ("write", "edit", "multiedit", "notebookedit")
FILE_VIEW_TOOLS = ("read", "write")
READ_TOOLS = ("read", "grep", "glob", "ls", "webfetch", "websearch", "notebookread")
ERROR = r"Traceback \(most recent call last\)|\bError\b|\bERROR\b|\bFAILED?\b|\bexit code [1-9]|Exception"
STALE_AFTER = 40
LARGE_RESULT = 4000
TRIM_HEAD = 1000
TRIM_TAIL = 1000
PRESERVE_RECENT = 6
REREAD_MIN_TOKENS = 50

# Filler words of speech, and what dictation looks like.
FILLER = r"(?i)\b(?:uh+|er+|ah+|eh+|um|basically|literally|you know|i mean|okay so|ok so|tipo assim|quer dizer|ou seja|peraí|então assim)\b"

# Kinds of secrets and identifiers, masked in this order.
REDACTIONS = (
    ("URL", r"[a-zA-Z][a-zA-Z0-9+.-]*://\S+"),
    ("EMAIL", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*"),
    ("TOKEN", r"(?i)\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd|senha|chave)\s*(?:[:=]|\bis\b)\s*\S+"),
    ("PATH", r"\b[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z0-9_]{1,6}\b"),
    ("HOST", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("NUMBER", r"\b[0-9][0-9.,/:-]{3,}[0-9]\b"),
)

# How the lines of a kind of passage look.
LINE_LOOKS = {
    "markdown_table": r"^[ \t]*\|?([ \t]*:?-+:?[ \t]*\|)+[ \t]*:?-+:?[ \t]*\|?[ \t]*$",
    "yaml": r"^\s*[A-Za-z0-9_.\-]+:\s*\S?",
    "logs": r"^\s*(\d{4}-\d{2}-\d{2}|\d{2}:\d{2}(:\d{2})?|INFO|DEBUG|WARN|ERROR|TRACE|LOG\b)",
    "code": r"^\s*(def |class |function |import |from |const |let |var |fn |func |public |private |if |for |while |return |#include|package |interface )",
    "config": r"^\s*[A-Za-z0-9_.\-/]+(\s*[:=]\s*|\s*=\s*)\S+",
}
# Words of passages in which nothing may be cut.
HIGH_RISK = (
    r"(?i)\b(?:indemnif\w*|liabilit\w*|lawsuit|arbitration|arbitrat\w*|dosage|prescri\w+|diagnos\w*|contraindicat\w*|fiduciar\w*|malpractice|overdose|chemotherapy|"
    r"insider\s+trading|money\s+laundering)\b"
)
