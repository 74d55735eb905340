"""Word lists, patterns and limits that results depend on."""

# Fixed values. Titles that match one of these, whatever the case, are no works.
TITLE_OPENERS = r"^(?:(?:publisher|author)\s+)?(?:correction|corrigendum|corrigenda|erratum|errata|retraction|retracted|editorial|guest editorial|foreword|preface|front[\s-]*matter|back[\s-]*matter|contents|table of contents|index to|author index|subject index|list of referees|special issue|masthead|information for authors|issue information)\b"
TITLE_ANYWHERE = r"\b(?:front[\s-]*matter|back[\s-]*matter|table of contents|corrigendum|erratum|obituary)\b"
TITLE_NOTICES = r"\b(?:corrigenda|errata)\s*(?:to\b|$)"

# Fixed values. Titles that name a kind of section and identify no work.
GENERIC_TITLES = ["introduction"]

# Fixed values. Where an abstract is cut, in this order.
ABSTRACT_CUTS = [
    r"©|\(C\)\s*\d{4}|\bCopyright\b",
    r"\bMSC(?:19\d\d|20\d\d)?\s*:",
    r"(?:\b20\d\d\s+)?\bMathematics subject classification\s*:",
    r"\bKeywords\s*:",
    r"(?:\b\d{2}[A-Z]\d{2}(?:\s*[,;]\s*\d{2}[A-Z]\d{2})*\s*)?\b1\.\s*Introduction\s+\d{1,5}\b",
    r"(?<=\.)\s*1\.\s*introduction\b",
]
#: Of each, one of which every match holds in lower case: a plain search tells that a text has none.
ABSTRACT_CUT_WORDS = [["©", "(c)", "copyright"], ["msc"], ["subject"], ["eywords"], ["introduction"], ["introduction"]]
DANGLING_CODES = r"\s*\b\d{2}[A-Z]\d{2}(?:\s*[,;]\s*\d{2}[A-Z]\d{2})*\s*$"
LEAST_WORDS = 15

# Fixed values. Years of publication counted.
FIRST_YEAR, LAST_YEAR = 2016, 2025

# Fixed values. Admissions: (client, all) in the last minute and hour.
PER_MINUTE, PER_HOUR = (6, 12), (40, 300)

# Fixed values. Markup that is stripped from text about mathematics; anything else after "<" is text.
MARKUP = r"</?(?:(?:jats|mml|math):)?(?:p|br|title|abstract|inline-formula|disp-formula|tex-math|math|mrow|mi|mn|mo|msub|msup|msubsup|mfrac|msqrt|mtext|semantics|annotation|i|b|em|strong|sup|sub|span)(?:\s+[^<>]*?)?\s*/?>"

# Fixed values. The label, the publication notices and the rights that are taken out of abstracts.
ABSTRACT_TITLE = r"<(?:\w+:)?title[^>]*>\s*Abstract\s*</(?:\w+:)?title>"
ABSTRACT_LABEL = r"^\s*Abstract\s*[:.]\s*"
PUBLICATION_NOTICE = r"(?:^|(?<=[.!?])\s+)(?:This (?:paper|article) (?:has been |was |is )?(?:accepted|published)|Published (?:in|online)|To appear in|Accepted for publication in)[^\n.!?]*(?:[.!?](?=\s|$)|\n|$)"
RIGHTS = r"(?:©|Copyright\s*\(?[cC]?\)?).*$"

# Fixed values. Font macros of TeX that are dropped before titles are compared.
TEX_FONTS = r"\\(?:mathbb|mathcal|mathrm|mathbf|mathfrak|operatorname|text|mathsf|mathscr)\b"

# Fixed values. Reasons for setting a record aside, with the field and the pattern; a later one overrides.
SET_ASIDE = [
    ("corrupted or incomplete source title", "title", r"\x{FFFD}|\b(?:for|of|in)\s*<\s*$"),
    ("award notice", "title", r"(?i)\bPaper Award\b"),
    ("special-issue introduction", "abstract", r"^This special issue"),
    ("PhD-thesis summary, not a research article", "abstract", r"(?i)\bthis (?:thesis|dissertation)\b"),
    ("unresolved equation-image identifiers in abstract", "abstract", r"urn:x-wiley:"),
    ("unrecoverable replacement characters in abstract", "abstract", r"\x{FFFD}"),
]
TOO_SHORT = "insufficient text after conservative cleanup"

# Fixed values. Tokens of a query, of a request's state and of a whole request.
QUERY_TOKENS, STATE_TOKENS, REQUEST_TOKENS = 768, 5504, 6144

# Fixed values. The service's paths, the largest bodies they take, its name, and the codes it may tell.
SUGGEST_PATH, IMPORT_PATH = "/api/suggest", "/api/import/arxiv"
SUGGEST_BYTES, IMPORT_BYTES = 150000, 2000
SITE = r"^[a-z0-9]+(?:[.-][a-z0-9]+)*\.[a-z]{2,}$"
OUT_OF_SCOPE, UNAVAILABLE = "arxiv_out_of_scope", "arxiv_unavailable"

# Fixed values. Shapes of identifiers, and of the addresses they come in.
DOI_ADDRESS = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
ARXIV_ADDRESS = r"^https?://(?:www\.)?arxiv.org/(?:abs|pdf)/"
ARXIV_ID = r"^(?:https://arxiv\.org/abs/)?(\d{2}(?:0[1-9]|1[0-2])\.\d{4,5}(?:v[1-9]\d*)?)$"
ARXIV_VERSION = r"v\d+$"
MATHEMATICS = r"^math\.[A-Z]{2}$"
CATEGORY = r"\(([a-z][a-z0-9-]*(?:\.[A-Za-z-]+)?)\)"

# Fixed values. Shapes of the publishers' pages.
ARCHIVE_LINK = "/j/{year}/{volume}-[0-9]+[.]html"
ARCHIVE_RULE = r"(?i)<hr\b[^>]*>"
ARCHIVE_TITLE = r'(?is)<td\b[^>]*class="[^"]*\bstyle60\b[^"]*"[^>]*>(.*?)</td>'
CARD = r'(?s)<a\b[^>]*class="publication .*?</a>'
CARD_PART = r'(?s)class="publication__{part}"[^>]*>(.*?)</(?:h3|div)>'
CARD_INFO = r"^(Livre|Article|Fascicule) - Tome ([\d-]+)(?: - pp (.*?))? - (\d{4})$"
PRODUCT = r"productDetailObj\s*=\s*\{"
PRODUCT_CODE = r"^MEMO/(\d+)/(\d+)$"
CONTENTS_ITEM = r'(?s)class="product__data-contents--c item-list"[^>]*>\s*(<a\b[^>]*href="[^"]+"[^>]*>.*?</a>)'
CONTENTS_TITLE = r"(?s)<strong>(.*?)</strong>"
DISPLAYED_DOI = r"<strong>DOI\s*:</strong>\s*([^<\s]+)"
PAPER_DOI = r"(?i)<strong>DOI\s*:</strong>\s*([^<]+)"
SHOWN_TITLE = r"""(?is)<p[^>]*class=["']style12["'][^>]*>(.*?)</p>"""
SHOWN_ABSTRACT = r"(?is)\bAbstract\s*<blockquote[^>]*>(.*?)</blockquote>"
ENGLISH_ABSTRACT = r'(?s)<div class="product__data-resume data-english[^"\n]*">(.*?)</div>'
ARTICLE_ABSTRACT = r'(?s)<article class="article-body edito">(.*?)</article>'
CITATION_TAG = r"""(?is)<meta\b(?=[^>]*\b(?:name|property)="{name}")[^>]*\bcontent="([^"]*)\""""
SUBJECTS_CELL = r'(?is)<td\b[^>]*class="[^"]*\bsubjects\b[^"]*"[^>]*>(.*?)</td>'
