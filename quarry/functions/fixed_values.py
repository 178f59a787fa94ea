"""Word lists, patterns and formats that results depend on."""

# fixed values: known sources
VALID_SOURCES = ("rbi", "sebi", "mca", "irdai", "egazette", "cbic", "cbdt", "icai", "ibbi", "dgft", "gst_council", "legislation", "practitioner_knowledge", "other")

# fixed values: importance of a record
MASTER = r"(?i)\b(master\s+(direction|circular)|master\s+dir\b)"
AMENDMENT = r"(?i)\b(amend(ment|ed|ing)?|modif(ication|ied|ying)|revis(ed|ion|ing)|updated?\s+guideline)"
KEYWORDS = (
    r"(?i)\b(NPA|IRAC|KYC|AML|Basel|FEMA|ECB|NBFC|PSL|SLR|CRR|LCR|co[\-\s]?lending|digital\s+lending|provisioning|priority\s+sector|capital\s+adequacy|risk\s+weight"
    r"|income\s+recognition|asset\s+classification|liquidity\s+coverage|net\s+stable\s+funding|prompt\s+corrective\s+action|PCA|large\s+exposure|fraud\s+reporting)\b"
)
CUTOFF_YEAR = 2024

# fixed values: date formats, tried in this order (for the year of a record, for ISO dates)
YEAR_FORMATS = ("MMM d, yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yyyy", "d-MMM-yyyy", "MMMM d, yyyy", "yyyy-M-d")
ISO_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "d-M-yyyy", "d-MMM-yyyy")

# fixed values: section headings, from most to least specific, with their levels
HEADINGS = (
    (r"^(\d+\.\d+[\.\d]*)\s+(.*)", 2),
    (r"^(\d+)\.\s+(\S.*)", 1),
    (r"(?i)^((?:X{0,3})(?:IX|IV|V?I{0,3}))\.\s+(.*)", 1),
    (r"^\((\d+)\)\s+(.*)", 2),
    (r"^([A-Z][A-Z\s]{3,}):?\s*$", 1),
)
# fixed values: section types: heading words, body patterns, and how many of the patterns must occur
SECTION_TYPES = (
    ("definition", ("definition", "interpretation"), (r'"[^"]+"\s+means', r'"[^"]+"\s+shall mean', r"defined\s+as"), 2),
    ("applicability", ("applicability", "scope", "application"), (r"applicable\s+to", r"applies\s+to", r"shall\s+apply\s+to"), 1),
    ("exception", ("exception", "exemption", "exclusion"), (r"shall\s+not\s+apply", r"notwithstanding", r"except\s+where", r"exempt\s+from"), 1),
    ("threshold", ("limit", "threshold", "cap", "ratio"), (r"Rs\.?\s*[\d,]+", r"\d+\s*%", r"\d+\s*crore", r"\d+\s*lakh"), 2),
    ("procedure", ("procedure", "process", "filing", "reporting", "manner of"), (r"step\s+\d", r"shall\s+(?:file|submit|report|furnish)", r"within\s+\d+\s+days"), 1),
    ("rule", ("requirement", "obligation", "compliance", "mandate"), (r"\bshall\b", r"\bmust\b", r"\bmandatory\b"), 2),
)
# fixed values: words of a question that prefer a chunk type
TYPE_WORDS = {
    "exception": ("exception", "exempt", "exemption", "carve-out", "carve out", "excluded", "exclusion", "not applicable"),
    "definition": ("definition", "defined as", "means", "what is", "what are", "meaning of"),
    "threshold": ("threshold", "limit", "percentage", "ratio", "amount", "cap", "ceiling", "minimum", "maximum", "how much"),
    "rule": ("rule", "regulation", "requirement", "mandatory", "must", "shall", "obligation", "compliance", "provision"),
    "applicability": ("applicable", "applicability", "applies to", "who", "which entities", "scope"),
    "procedure": ("procedure", "process", "how to", "steps", "filing", "submit", "report", "manner of"),
}
# fixed values: words of a question that ask for graph retrieval
INTENT_WORDS = {
    "chain": ("amendment chain", "history of", "previous version", "superseded by", "evolution", "amendment history", "how has", "changed over time", "earlier version", "prior circular"),
    "latest": ("latest", "current version", "most recent", "in force", "currently applicable", "current circular", "latest version"),
    "impact": ("impact", "affected entities", "who does this apply to", "blast radius", "who is affected", "which entities", "who must comply", "applicability"),
    "summary": ("all circulars from", "summary of rbi", "summary of sebi", "summary of irdai", "summary of mca", "overview of recent", "recent circulars", "all recent"),
    "related": ("related circulars", "similar circulars", "other circulars about", "related regulations", "other regulations on", "connected circulars"),
    "cross_reference": ("across regulators", "both rbi and sebi", "both sebi and rbi", "cross-regulator", "cross regulator", "compare requirements", "rbi and irdai", "irdai and rbi", "sebi and mca", "mca and sebi", "how do different regulators", "multiple regulators"),
}
# fixed values: acronyms that say nothing
GENERIC_ACRONYMS = ("PDF", "FAQ", "URL", "API")

# fixed values: references between circulars
REFERENCE = r"(?i)(?:RBI|SEBI|IRDAI|MCA|CBIC|CBDT|ICAI|IBBI|DGFT)[/\-]\d{4}[\-]\d{2,4}[/\-]\d+"
QUESTION_REFERENCE = r"(?i)(?:RBI|SEBI|IRDAI|MCA)[/\-]\d{4}[\-]\d{2,4}[/\-]\d+"
RECORD_REFERENCE = r"(?:RBI|SEBI|IRDAI|MCA)[/\-][\w\-/]+(?:\d{2,})"
SUPERSEDES = (
    r"(?i)(?:supersede[sd]?|replace[sd]?|revoke[sd]?|withdraw[sn]?|repeal(?:ed|s)?|rescind(?:ed|s)?|cancel(?:led|s)?|in\s+(?:supersession|replacement)\s+of)"
    r"\s+(?:the\s+)?(?:earlier\s+)?(?:circular\s+(?:no\.?\s*)?|notification\s+(?:no\.?\s*)?|direction\s+(?:no\.?\s*)?|master\s+direction\s+(?:no\.?\s*)?)?"
)
EARLIER = r"(?i)(?:earlier|previous|old|erstwhile)\s+(?:circular|direction|notification|master\s+direction)\s+(?:no\.?\s*)?"
AMENDS = (
    r"(?i)(?:amend(?:s|ed|ment|ing)?|modif(?:y|ies|ied|ication)|insert(?:s|ed|ing)?|substitut(?:e[sd]?|ing|ion))"
    r"\s+(?:the\s+)?(?:following\s+)?(?:provision[s]?\s+(?:of\s+)?(?:the\s+)?)?((?:[\w\s\(\)]+?)(?:Act|Rules?|Regulations?|Direction[s]?|Guidelines?|Norms?))(?:\s*,\s*\d{4})?"
)
APPLIES_TO = r"(?i)(?:appli(?:es|cable|cability)\s+to|shall\s+apply\s+to|applicable\s+to\s+all|directed\s+to\s+all)\s+([\w\s\(\)/\-,]+?)(?:\.|,\s*(?:who|which|that|as|with)|$)"
SECTION_OF_ACT = r"(?i)(?:section|sec\.?)\s+(\d+[A-Z]?)\s+(?:of\s+)?(?:the\s+)?(CGST|IGST|UTGST|GST\s*Compensation)\s*(?:Act)?"
RULE_OF_RULES = r"(?i)(?:rule)\s+(\d+[A-Z]?)\s+(?:of\s+)?(?:the\s+)?(CGST|IGST|GST\s*Compensation)\s*(?:Rules?)?"

# fixed values: boundaries of parts of legislation, rules, directions and markdown
SPLITTERS = {
    "act": (r"(?:^|\n)\s*(?:SECTION|Section|section)\s+(\d+[A-Z]?)\s*[.—–\-]+\s*(.+?)(?=\s*[.—–\-])", r"(?:^|\n)\s*(\d+[A-Z]?)\s*\.\s+([A-Z][^.\n]{3,60})\s*[.—–\-]"),
    "rules": (r"(?:^|\n)\s*(?:RULE|Rule|rule)\s+(\d+[A-Z]?)\s*[.—–\-]+\s*(.+?)(?=\s*[.—–\-])", r"(?:^|\n)\s*(\d+[A-Z]?)\s*\.\s+([A-Z][^.\n]{3,80})\s*[.—–\-]"),
    "direction": (r"(?i)(?:^|\n)\s*(Chapter\s+[IVXLC]+(?:\s*[-–—.:]\s*|\s+))([^\n]+)", r"(?:^|\n)\s*(\d+)\s*[.\-–]\s+([A-Z][^\n]{5,80})"),
    "markdown": (r"^##\s+(.+)$",),
}
LETTERED = r"(?:^|\n)\s*([A-Z])\s*[.\-–]\s+([^\n]{5,80})"

# fixed values: words of a question that name a domain, and the sources of each
DOMAINS = {
    "gst": (
        ("gst", "cgst", "igst", "sgst", "utgst", "itc", "input tax credit", "gstr", "gstr-1", "gstr-3b", "gstr-9", "gstr-9c", "section 128a", "section 16", "section 17", "section 54",
         "section 14", "section 103", "section 143", "section 171", "rule 89", "rule 36", "rule 42", "rule 43", "rule 164", "compensation cess", "e-way bill", "ims", "invoice management",
         "anti-profiteering", "advance ruling", "gstat", "appellate tribunal", "spl-01", "spl-02", "drc-03", "rcm", "reverse charge", "hsn", "sac", "gta", "job worker", "inverted duty",
         "job work", "challan", "moulds", "dies", "jigs", "fixtures", "credit note", "debit note", "banquet", "advance payment", "health insurance premium", "blocked credit",
         "mrp", "legal metrology", "binding effect", "table 8a", "table 8c", "qrmp", "quarterly return", "capital subsidy", "state incentive", "emi deferred duty"),
        ("cbic", "legislation", "gst_council", "practitioner_knowledge"),
    ),
    "customs": (("customs", "bill of entry", "hs code", "import duty", "reassessment", "voluntary compliance", "customs act", "importer", "customs duty"), ("cbic", "legislation", "practitioner_knowledge")),
    "rbi": (
        ("rbi", "nbfc", "npa", "crar", "kyc", "ecb", "sbr", "scale-based", "gold loan", "securitisation", "master direction", "reserve bank", "ucb", "urban co-operative bank", "cooperative bank",
         "gold lending", "ltv", "loan-to-value", "uapa", "sanctions", "str", "fiu-ind", "fiu", "nbfc-factor", "factoring", "floating rate", "floating-rate", "emi reset"),
        ("rbi", "practitioner_knowledge"),
    ),
    "sebi": (("sebi", "lodr", "sast", "stock broker", "mutual fund", "ipo", "insider trading", "takeover"), ("sebi", "practitioner_knowledge")),
}
# fixed values: how an asker names their own kind of entity
ASKER = (
    r"(?i)(?:we are|I am|as a|our company is|we're)\s+(?:a |an )?((?:Type\s*[1-4]\s+)?(?:NBFC|HFC|bank|manufacturer|manufacturing company|exporter|importer|borrower|listed company|unlisted company|"
    r"SIDBI|shipping company|infrastructure company|startup|MSME|corporate|partnership firm|LLP|mutual fund|insurance company|broker|dealer|registered entity|category [I-IV]+ ?(?:AIF|FPI|merchant banker)?))"
)
# fixed values: words that leave nothing else asked of a circular but to explain it
ANALYSIS_FILLER = r"\b(?:analyze|analyse|analysis|explain|summary|summarize|summarise|tell me about|what is|what does|describe|give me|show me|details of|overview of|break down|breakdown)\b"
