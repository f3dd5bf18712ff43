"""Regular expressions, stated as fixed values in Java syntax.

Each has to accept exactly the published wording for results to agree. Flags:
``i`` ignore case, ``U`` Unicode classes and word boundaries, ``m``/``d`` lines end
at ``\\n`` only, ``s`` dot matches newlines.
"""

import string


def _among(characters: str) -> str:
    """A cheap test of the next character: of ASCII only ``characters``, upper or lower case; others are left to the pattern.

    It is told as the ASCII characters that may not follow, one by one, which Java looks up in a table.
    """
    return "(?![" + "".join(rf"\x{c:02x}" for c in range(128) if chr(c).lower() not in characters) + "])"


def _starts(characters: str, pattern: str) -> str:
    """The pattern behind a test of its first character, so that case folding and boundaries are tried at few places."""
    return _among(characters) + pattern


def _word(characters: str, pattern: str) -> str:
    """The same for a pattern that begins with a word boundary and a letter: no ASCII letter or digit stands before it."""
    return _starts(characters, f"(?<![{string.ascii_letters}{string.digits}]){pattern}")


# Whitespace as a text scan sees it: ASCII, separators and the Unicode spaces.
SPACE_CHARS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# a table of single characters and one range are asked first: no other character gets to the class itself
_PERHAPS_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680-\u3000"
SPACE = f"[{_PERHAPS_SPACE}&&[{SPACE_CHARS}]]"
# the same without the newline
INLINE_SPACE = r"[ \t\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# a run of whitespace that is not one plain space already
UNTIDY_SPACE = _among("\t\n\x0b\f\r\x1c\x1d\x1e\x1f ") + f"{SPACE}(?:(?<! ){SPACE}*|{SPACE}+)"
# the characters themselves, for trimming
SPACE_TEXT = "".join(
    chr(c)
    for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# -- index lines ------------------------------------------------------------
INDEX_ROW = (
    r"(?U)^(\S(?:.*?\S)?)\s{2,}(\S(?:.*?\S)?)\s+(\d{1,10})\s+"
    r"(\d{4}-\d{2}-\d{2})\s+(edgar/\S+)\s*$"
)
INDEX_RULER = "----"

# -- sections ---------------------------------------------------------------
HEADING_SPLIT = rf"(?imdU)(?=^[ \t>*]*item{SPACE}*\d{{1,2}}\.\d{{2}}\b)"
HEADING_CODE = rf"(?iU)^[ \t>*]*item{SPACE}*(\d{{1,2}}\.\d{{2}})\b"
TITLE_LINE = rf"(?iU)^[ \t>*]*item{SPACE}*\d{{1,2}}\.\d{{2}}[.\t ]*[^\n]*\n?"
HEADING_LINE = (
    rf"(?iU)^[ \t>*]*item{SPACE}*\d{{1,2}}\.\d{{2}}[.{SPACE_CHARS}]*(?:termination|entry)[^\n]*\n?"
)
TITLE_ONLY_CHARS = 140
ANY_DIGIT = r"[\p{Nd}\u00b2\u00b3\u00b9]"

# -- termination notices ----------------------------------------------------
MERGER_AGREEMENT = _word(
    "ambspt",
    r"(?iU)\b(agreement and plan of (?:merger|reorganization|amalgamation|share exchange)|"
    r"merger agreement|amalgamation agreement|share exchange agreement|"
    r"business combination agreement|arrangement agreement|"
    r"scheme implementation (?:agreement|deed)|plan of arrangement|"
    r"(?:the\s+)?transaction agreement)\b",
)
OTHER_AGREEMENT = _word(
    "abcdefgijlmnoprstuw",
    r"(?iU)\b(credit agreement|credit facility|loan agreement|revolving credit|"
    r"term loan|indenture|note purchase agreement|securities purchase agreement|"
    r"lease agreement|employment agreement|license agreement|"
    r"distribution agreement|supply agreement|collaboration agreement|"
    r"underwriting agreement|at.the.market|"
    r"(?:stock |equity )?(?:option|incentive|compensation|benefit) plan|"
    r"forward (?:contract|purchase agreement)|swap agreement|"
    r"investor rights agreement|registration rights agreement|"
    r"consulting agreement|advisory agreement|management agreement|"
    r"services agreement|joint venture agreement|"
    r"purchase and sale agreement|asset purchase agreement|"
    r"lease(?: agreement| termination agreement)?|security agreement|"
    r"guarant(?:y|ee) agreement|warrant plan|development agreement|"
    r"promissory note|senior notes?|convertible notes?)\b",
)
TERMINATION = _word(
    "tmwae",
    r"(?iU)\b(terminat(?:e|ed|es|ing|ion)|mutually agreed to (?:end|terminate)|"
    r"withdraw(?:n|al)?|abandon(?:ed|ment)?|expired without)\b",
)
# reason -> pattern, in reporting order
REASONS = {
    "regulatory": _word(
        "ahsdfecr",
        r"(?iU)\b(antitrust|hart.scott.rodino|second request|"
        r"(?:department of justice|federal trade commission|european commission)|"
        r"cfius|competition authority|regulatory approval(?:s)? (?:was|were) not|"
        r"failed to (?:obtain|receive) .{0,40}(?:regulatory|antitrust))\b",
    ),
    "superior_proposal": _word(
        "sacu",
        r"(?iU)\b(superior proposal|alternative acquisition (?:proposal|agreement)|"
        r"competing (?:proposal|offer|bid)|unsolicited proposal)\b",
    ),
    "shareholder_vote": _word(
        "sfdr",
        r"(?iU)\b((?:stock|share)holders? (?:did not|failed to) approve|"
        r"(?:failed|did not) (?:to )?(?:obtain|receive) the requisite|"
        r"requisite (?:stock|share)holder (?:approval|vote) was not)\b",
    ),
    "financing": _word(
        "fd",
        r"(?iU)\b(failure to (?:obtain|fund) .{0,30}financing|"
        r"financing (?:was|were) not (?:obtained|available)|debt financing failed)\b",
    ),
    "outside_date": _word(
        "oetb",
        r"(?iU)\b((?:outside|end|termination) date (?:had |has )?(?:passed|occurred|expired)|"
        r"(?:on or (?:prior to|before)|by) the (?:outside|end) date)\b",
    ),
    "material_adverse": _word("mc", r"(?iU)\b(material adverse (?:effect|change)|company material adverse)\b"),
    "mutual": _word("m", r"(?iU)\b(mutual (?:agreement|consent|written consent)|mutually agreed)\b"),
}
DEFINITION = (
    r"[\(\[] *(?:the|this)? *[\"\u201c\u2018']([A-Z][A-Za-z0-9 &.\-]{1,60}?)"
    r"[\"\u201d\u2019'] *[\)\]]"
)
DEFINITION_LOOKBACK = 160
NAMED_INSTRUMENT = (
    r"(?U)\b((?:[A-Z][A-Za-z&-]+ ){1,4}(?:Agreement|Plan|Notes?|Lease|Contract))\b"
)
NOT_DISTINGUISHING = (
    r"(?iU)^(?:the |this |such )?(?:material definitive|definitive|termination|"
    r"merger|amalgamation|arrangement|business combination|share exchange|transaction)\b"
)
BREAK_FEE = _starts(
    "tb",
    r"(?iU)(?:termination|break.?up|break)\s+fee[^.]{0,120}?\$\s?([\d,]+(?:\.\d+)?)\s*"
    r"(million|billion|thousand)?",
)
EXCERPT_CHARS = 600
EXCERPT_CHARS_NO_TERMINATION = 400

# -- announcement terms -----------------------------------------------------
CASH_PER_SHARE = (
    r"(?iU)\$\s?(\d{1,4}(?:\.\d{1,4})?)\s*(?:per share|in cash|for each share|"
    r"in cash for each|per share in cash)"
)
EXCHANGE_RATIO = (
    r"(?iU)(\d\.\d{2,6})\s+(?:validly issued,? fully paid.{0,40}?)?shares? of\b"
    r"[^.]{0,80}?common stock"
)
PREMIUM = _starts(
    "pan0123456789",
    r"(?iU)(?:premium of (?:approximately |about |roughly |nearly )?"
    r"(\d{1,3}(?:\.\d{1,2})?)\s?(?:%|percent)"
    r"|(?:a |an )?(?:nearly |approximately |about )?"
    r"(\d{1,3}(?:\.\d{1,2})?)\s?(?:%|percent)\s+premium)",
)
AVERAGE_BASELINE = r"(?iU)(average|volume.weighted|vwap|\d{1,3}[- ](?:calendar |trading )?day)"
BASELINE_WINDOW = 200
PREMIUM_CONTEXT = 320
UNAFFECTED = (
    r"(?iU)closing (?:sale |market )?price(?: per share)? of (?:[^.$]{0,80}?)"
    r"\$\s?(\d{1,4}(?:\.\d{1,4})?)"
)
TERMINATION_FEE = _starts(
    "ct",
    r"(?iU)(?<!parent )(?<!reverse )(?:company )?termination fee"
    r"(?: of| equal to| in the amount of)?\s*"
    r"\$\s?([\d,]+(?:\.\d+)?)\s*(thousand|million|billion)?",
)
PARENT_FEE = _starts(
    "pr",
    r"(?iU)(?:parent termination fee|reverse termination fee)(?: of| equal to)?\s*"
    r"\$\s?([\d,]+(?:\.\d+)?)\s*(thousand|million|billion)?",
)
EQUITY_VALUE = _starts(
    "eat",
    r"(?iU)(?:equity value|aggregate consideration|transaction value(?:d)?|enterprise value)"
    r"[^.$]{0,80}\$\s?([\d,]+(?:\.\d+)?)\s*(thousand|million|billion)?",
)
SCALE_WORD = r"(?iU)^\s*(thousand|million|billion)"
OUTSIDE_DATE = _starts(
    '"eot',
    r"(?iU)(?:\"?(?:end date|outside date|termination date)\"?)[^.]{0,120}?"
    r"((?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},\s+\d{4})",
)
NO_FINANCING_CONDITION = (
    r"(?iU)(?:not (?:subject to|conditioned (?:up)?on) (?:any |a )?financing|"
    r"no financing condition)"
)
FINANCING_CONDITION = r"(?iU)financing condition"
GO_SHOP = r"(?iU)go.?shop"
HSR = r"(?iU)hart.scott.rodino|hsr act"
CFIUS = r"(?iU)\bcfius\b|committee on foreign investment"
TENDER_OFFER = r"(?iU)\b(?:tender offer|exchange offer)\b"

# Characters that patterns take for ASCII letters when they ignore case, and those letters.
FOLDED, FOLDED_TO = "\u017f\u212a\u0130\u0131", "skii"

# Words a text must contain (in lower case) before a pattern can match at all.
NEEDED_WORDS = {
    MERGER_AGREEMENT: [
        "agreement and plan of", "merger agreement", "amalgamation agreement", "share exchange agreement",
        "business combination agreement", "arrangement agreement", "scheme implementation", "plan of arrangement",
        "transaction agreement",
    ],
    OTHER_AGREEMENT: [
        "agreement", "credit facility", "revolving credit", "term loan", "indenture", "market", " plan",
        "forward contract", "lease", "promissory note", "senior note", "convertible note",
    ],
    TERMINATION: ["terminat", "mutually agreed to", "withdraw", "abandon", "expired without"],
    REASONS["regulatory"]: [
        "antitrust", "rodino", "second request", "department of justice", "federal trade commission",
        "european commission", "cfius", "competition authority", "regulatory",
    ],
    REASONS["superior_proposal"]: [
        "superior proposal", "alternative acquisition", "competing", "unsolicited proposal",
    ],
    REASONS["shareholder_vote"]: ["approve", "requisite"],
    REASONS["financing"]: ["financing"],
    REASONS["outside_date"]: ["outside date", "end date", "termination date"],
    REASONS["material_adverse"]: ["material adverse"],
    REASONS["mutual"]: ["mutual"],
    BREAK_FEE: ["fee"],
    CASH_PER_SHARE: ["per share", "in cash", "for each share"],
    EXCHANGE_RATIO: ["common stock"],
    PREMIUM: ["premium"],
    TERMINATION_FEE: ["termination fee"],
    PARENT_FEE: ["parent termination fee", "reverse termination fee"],
    EQUITY_VALUE: ["equity value", "aggregate consideration", "transaction value", "enterprise value"],
    OUTSIDE_DATE: ["end date", "outside date", "termination date"],
    NO_FINANCING_CONDITION: ["financing"],
    FINANCING_CONDITION: ["financing condition"],
    GO_SHOP: ["shop"],
    HSR: ["rodino", "hsr act"],
    CFIUS: ["cfius", "committee on foreign investment"],
    TENDER_OFFER: ["tender offer", "exchange offer"],
}

# Characters of a flat text, in which white space is one space, that a match and what it looks back at may have before the first
# of its needed words, and the most it may have behind its last one (None: any number).
REACH = {
    CASH_PER_SHARE: (16, 0),
    EXCHANGE_RATIO: (200, 0),
    PREMIUM: (40, 40),
    TERMINATION_FEE: (16, None),
    PARENT_FEE: (0, None),
    EQUITY_VALUE: (0, None),
    OUTSIDE_DATE: (1, None),
}

# -- passages worth reading -------------------------------------------------
ANCHORS = _starts(
    "mptb%ucoefagn",
    r"(?iU)(merger consideration|per share in cash|termination fee|break.?up fee|"
    r"premium of|% premium|percent premium|unaffected|closing (?:sale |market )?price|"
    r"outside date|end date|financing condition|equity value|exchange ratio|"
    r"aggregate consideration|go.?shop|no.?shop)",
)
PASSAGE_WINDOW = 700
PASSAGE_BUDGET = 30_000
PASSAGE_JOIN = "\n[...]\n"

# -- document choice --------------------------------------------------------
EXHIBIT_NAME = r"(?iU)(^|[^a-z])(d?ex|exhibit)[-_]?\d"
CURRENT_REPORT_NAME = r"(?iU)8-?k"
PRESS_RELEASE_NAME = r"(?iU)(^|[^a-z])(d?ex)-?99"
READABLE_SUFFIX = r"(?i)\.(htm|html|txt)$"
HTML_SUFFIX = r"(?i)\.(htm|html)$"

# -- markup -----------------------------------------------------------------
DROPPED_MARKUP = (
    r"(?is)<!--.*?(?:--!?>|\z)|<(script|style)(?:[\s/][^>]*)?>.*?(?:</\1[^>]*>|\z)"
    r"|<![^>]*>|<\?[^>]*>"
)
DROPPED_ELEMENT = r"(?is)<(head|title)(?:[\s/][^>]*)?>.*?(?:</\1[^>]*>|\z)"
BLOCK_TAG = (
    r"(?i)</?(?:p|div|br|tr|table|li|ul|ol|h1|h2|h3|h4|h5|h6|td|th|section|article)"
    r"(?:[\s/][^>]*)?>"
)
ANY_TAG = r"(?i)</?[a-z][^>]*>"
ENTITY = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
