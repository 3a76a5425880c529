"""Word lists, patterns and types that results depend on.

They are data, stated plainly and together; no logic is here.
"""

# --- entity lexicon of narrative business documents ---
THEME_ALIASES = {
    "AI demand": ("ai demand", "ai workload", "ai usage", "ai products", "agentic ai", "compute needs"),
    "AI capex": ("ai capex", "capex", "capital expenditures", "infrastructure capex", "infrastructure spend"),
    "cloud growth": ("cloud", "azure", "microsoft cloud", "creative cloud"),
    "data center capacity": ("data center", "capacity", "compute", "power", "inference capacity"),
    "semiconductor supply": ("semiconductor", "leading-edge", "advanced nodes", "3-nanometer", "n3", "hpc"),
    "component cost": ("memory pricing", "component pricing", "higher component costs"),
    "FX headwind": ("fx", "foreign exchange", "currency"),
    "consumer demand": ("consumer", "unit case volume", "nartd"),
    "pricing power": ("pricing", "price/mix", "revenue growth management"),
    "margin pressure": ("margin", "gross margin", "operating margin", "cost pressure", "expense"),
    "regulatory risk": ("regulatory", "legal", "eu", "scrutiny"),
}
METRIC_TERMS = ("ARR", "MAU", "N3 capacity", "AI credit consumption", "Azure growth", "CapEx", "capital expenditures", "cloud revenue", "compute needs", "cost of revenue", "gross margin", "inference capacity", "infrastructure capex forecast", "monthly active users", "operating margin", "price/mix", "revenue", "total expenses", "unit case volume")
RISK_TERMS = ("capacity constraint", "capacity tightness", "component costs", "data center operating costs", "depreciation", "execution timing", "foreign exchange", "gross margin pressure", "investment efficiency", "margin dilution", "margin pressure", "memory pricing", "near-term ARR impact", "regulatory scrutiny")
CLAIM_KEYWORDS = ("expect", "forecast", "growth", "increase", "increased", "raising", "raised", "demand", "cost", "expense", "margin", "capacity", "risk", "pressure", "investment", "capex", "revenue")
ACRONYM_STOP = ("CEO", "CFO", "Q", "A")

# --- stance and claim type: ordered tests ---
NEGATIVE = ("risk", "pressure", "headwind", "cost", "expense", "dilution", "decline")
OFFSETTING = ("growth", "demand", "offset", "investment", "opportunity")
POSITIVE = ("growth", "demand", "opportunity", "strong", "robust", "increase")
CLAIM_TYPES = (
    ("cost_burden", ("cost", "expense", "capex", "capital expenditure", "margin", "depreciation")),
    ("risk", ("risk", "constraint", "pressure", "headwind")),
    ("demand_signal", ("demand", "growth", "usage", "adoption")),
)
QA_TOKENS = ("q&a", "qa", "question-and-answer", "questions and answers", "질의", "질문")

# --- concept resolution ---
GENERIC_TOKENS = ("ai", "business", "capacity", "cloud", "compute", "cost", "customers", "data", "demand", "growth", "margin", "memory", "nvidia", "performance", "power", "product", "products", "revenue", "risk", "sales", "search", "servers", "storage", "systems")
UNRESOLVED_TYPES = ("Company", "Geography", "TimePeriod")
RULE_CONFIDENCE = 0.96
RESOLUTION_RULES = (
    ("concept-ai-demand", "AI workload demand", (r"\b(ai|genai|generative ai|agentic ai)\s+(demand|workloads?|usage|adoption|orders?|solutions?)\b", r"\b(demand|workloads?|usage|adoption|orders?)\s+(for|from)?\s*(ai|genai|generative ai)\b", r"\b(frontier|foundation)\s+models?\b")),
    ("concept-infrastructure-capex", "infrastructure CapEx", (r"\b(capex|capital expenditures?|capital intensity)\b", r"\b(infrastructure|data center|technical infrastructure|ai)\s+(spend|investment|capex)\b", r"\broi\s+on\s+capex\b")),
    ("concept-revenue-growth", "revenue growth", (r"\b(revenue|sales)\s+(growth|grew|increase|acceleration|run rate)\b", r"\b(cloud|azure|data center|gaming|advertising|ads?)\s+revenue\b", r"\b(cloud|azure|data center)\s+growth\b", r"\b(arr|annual recurring revenue|run rate)\b")),
    ("concept-cloud-platform-segment", "cloud platform segment", (r"\b(azure|google cloud|gcp|aws|oci|oracle cloud|microsoft cloud)\b", r"\bcloud\s+(platform|services?|customers?|migration|infrastructure|subscriptions?|growth)\b")),
    ("concept-operating-margin-pressure", "operating margin pressure", (r"\b(operating|gross)\s+margin\b", r"\bmargin\s+(pressure|headwind|dilution|compression|expansion)\b", r"\b(operating expenses?|opex|depreciation|cost pressure)\b")),
    ("concept-component-cost-pressure", "component cost pressure", (r"\b(component|input|supply chain|manufacturing)\s+costs?\b", r"\bcost\s+(inflation|variability|pressure|headwind)\b")),
    ("concept-supply-constraint", "supply constraint", (r"\b(supply|capacity|component|inventory)\s+constraints?\b", r"\bstructural supply\b", r"\bcompute constrained\b")),
    ("concept-data-center-capacity", "data center / compute capacity", (r"\bdata centers?\b", r"\b(compute|inference|gpu|tpu)\s+capacity\b", r"\badvanced packaging\b")),
    ("concept-power-cooling", "power / cooling constraint", (r"\b(power|energy)\s+(supply|constraints?|costs?)\b", r"\b(liquid )?cooling\b")),
    ("concept-memory-bandwidth", "memory bandwidth / HBM", (r"\b(hbm|high bandwidth memory|dram|nand|ddr5|memory bandwidth)\b",)),
    ("concept-storage-capacity", "storage capacity", (r"\b(storage|ssd|hdd|mass-capacity|enterprise storage)\b",)),
    ("concept-networking-fabric", "networking fabric", (r"\b(networking fabric|ethernet|nvlink|interconnect|switching|routing)\b", r"\bdata center networking\b")),
    ("concept-ai-product-monetization", "AI product monetization", (r"\b(ai|cloud|product|ads?|advertising|subscription)\s+moneti[sz]ation\b", r"\b(advertising|ads?|subscription|subscriptions|ai services?)\s+(revenue|growth|business)\b", r"\b(credit consumption|paid subscriptions?)\b")),
    ("concept-enterprise-ai-adoption", "enterprise AI adoption", (r"\benterprise\s+ai\b", r"\b(copilot|gemini enterprise|business process automation|customer adoption|internal ai adoption)\b", r"\bautomation\b")),
    ("concept-ai-efficiency", "AI efficiency", (r"\b(engineering|ai|cost|hardware)\s+efficienc(y|ies)\b", r"\b(latency|throughput|price performance|cost efficiency|productivity)\b")),
    ("concept-fx-impact", "foreign exchange impact", (r"\b(fx|foreign exchange|currency|constant currency)\b",)),
    ("concept-regulatory-compliance-risk", "regulatory / compliance risk", (r"\b(regulatory|regulation|compliance|privacy|data governance|digital trust)\b", r"\b(tariffs?|trade policy|geopolitical)\b")),
    ("concept-consumer-demand", "consumer demand", (r"\bconsumer\s+demand\b", r"\bconsumer\s+(market|devices?|engagement)\b")),
    ("concept-pricing-power", "pricing power", (r"\b(pricing power|pricing strategy|price increases?|asp|average price)\b",)),
    ("concept-capital-allocation", "capital allocation", (r"\b(capital allocation|shareholder returns?|share repurchases?|buybacks?|dividends?)\b",)),
)

# --- questions ---
QUESTION_STOPWORDS = ("what", "does", "how", "why", "which", "the", "and", "with", "from", "that", "this", "graph", "affect", "affects", "impact", "impacts", "ontology", "concept")
ROUTES = (  # tool, any of these, and (if given) any of those; first match wins
    ("company_ai_deep_dive", ("nvidia", "nvda", "cisco", "csco", "microsoft", "msft", "alphabet", "googl", "google"), ("ai", "blackwell", "data center", "revenue", "demand", "deep dive")),
    ("frequent_entities", ("frequently mentioned entities", "most frequently mentioned entities", "most mentioned entities", "top entities", "common entities", "entity frequency", "entity ranking", "mentioned entities"), ()),
    ("product_category_evidence_map", ("product category", "category", "ai accelerator", "accelerator", "gpu", "blackwell", "custom silicon", "semiconductor", "networking", "storage"), ("evidence", "summarize", "map", "across", "company", "companies", "loaded graph")),
    ("ai_positive_demand_by_company", ("positive demand", "demand signals", "positive signals", "ai infrastructure demand", "ai infrastructure industry"), ()),
    ("ai_risks_constraints_by_company", ("risk", "risks", "constraint", "constraints", "bottleneck", "bottlenecks", "shortage", "shortages", "headwind", "headwinds", "limit", "limits", "limited", "pressure", "margin pressure", "supply", "capacity", "capex", "regulation", "regulatory", "export control"), ("ai", "infrastructure", "data center", "accelerator", "cloud", "growth", "company", "companies")),
    ("loaded_company_universe", ("which companies", "what companies", "list companies", "show companies", "loaded companies", "company universe", "which tickers", "what tickers", "loaded tickers"), ("loaded", "available", "covered", "current", "universe", "graph")),
)
TOOL_TERMS = {  # tool: (category terms, signal terms)
    "ai_positive_demand_by_company": (("ai", "ai infrastructure", "cloud", "networking", "custom silicon", "accelerator", "blackwell", "data center", "semiconductor", "storage", "server"), ("growth", "demand", "revenue", "order", "backlog", "adoption", "capacity", "production", "strong", "increase")),
    "ai_risks_constraints_by_company": (("ai", "ai infrastructure", "cloud", "networking", "custom silicon", "accelerator", "blackwell", "data center", "semiconductor", "storage", "server"), ("risk", "constraint", "constrain", "bottleneck", "shortage", "limited", "limit", "capacity", "supply", "capex", "cost", "margin", "pressure", "power", "energy", "regulation", "regulatory", "export", "competition")),
    "product_category_evidence_map": (("ai accelerator", "accelerator", "gpu", "blackwell", "custom silicon", "ai infrastructure", "data center", "semiconductor", "networking", "cloud", "capacity"), ("demand", "revenue", "growth", "capex", "capacity", "supply", "production", "order", "backlog", "customer", "adoption")),
}

# --- sources ---
SOURCE_ADAPTERS = (  # name, domain, source type; first match wins
    ("adobe-ir-pdf", "adobe.com", "transcript_pdf"),
    ("q4cdn-pdf", "q4cdn.com", "transcript_pdf"),
    ("amazon-ir-html", "ir.aboutamazon.com", "earnings_release_html"),
    ("apple-newsroom-pdf", "apple.com", "earnings_release_pdf"),
    ("microsoft-ir-html", "microsoft.com", "earnings_event_html"),
    ("tsmc-ir-pdf", "investor.tsmc.com", "transcript_pdf"),
)
CONFERENCE_CALL_TYPES = ("transcript_pdf", "transcript_html", "conference_call_transcript_html", "conference_call_event_html", "conference_call_prepared_remarks_html", "conference_call_prepared_remarks_pdf", "earnings_call_transcript_html", "seeking_alpha_transcript_html", "third_party_transcript_html")
# layout of extracted text: what a paragraph looks like, and how long it may be
PAGE_PREFIX = "Page "
NAME_AND_TITLE = r"^[A-Z][A-Za-z .'-]{1,80},? (CEO|CFO|Chief|EVP|President|Chairman)\b"
NAME_AND_COLON = r"^[A-Z][A-Za-z .'-]{1,80}:\s"
NAME_ALONE = r"^[A-Z][A-Za-z .'-]{2,80}\s*:$"
HEADING_CHARS, OPEN_END_CHARS, SHORT_REST_CHARS = 90, 90, 55
SENTENCE_ENDS = (".", "!", "?", ":")
# Markdown lines of speakers, and page marks
SPEAKER_LINES = (
    r"\*\*([^*:\n]{2,120})\*\*\s*:\s*(.*)$",
    r"\*\*([^*:\n]{2,120}):\*\*\s*(.*)$",
    r"([A-Z][^:\n]{1,120})\s*:\s*(.+)$",
)
PAGE_MARK, PAGE_NUMBER = r"(?i)page\s+\d+", r"\d{1,4}"
# transcript links: what raises or rules out a candidate
LINK_TRANSCRIPT = ("transcript", "q&a", "qanda")
LINK_CALL = ("prepared remark", "conference call", "earnings call")
LINK_NEVER = ("slide", "powerpoint", "annual-report", "download-center", "presentation", "press release", "earnings release", "financial statement", "financial result", "financial and business result")
LINK_PDF = (".pdf",)
LINK_DOCX = (".docx", "officeapps.live.com", "aka.ms/transcript", "transcript")
LINK_POINTS = {"transcript": 50, "call": 30, "pdf": 100, "docx": 70}
# answer clean-up: sections and table columns that go
GAP_SECTIONS = ("evidence gap", "caveat")
SIGNAL_COLUMNS = ("positive signal", "product/category signal", "signal", "evidence", "why it matters")
SOURCE_NOTE = "> Full official source text extracted from"
AUDIT_POSITIVE = ("transcript", "earnings", "prepared-remarks", "prepared_remarks", "results", "quarter", "q1", "q2", "q3", "q4", "call")
AUDIT_OFF_TOPIC = ("supply-chain", "transparency", "sustainability", "annual-report", "annual_report", "proxy", "code-of-conduct", "privacy")
