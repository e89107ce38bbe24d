"""Word lists, rule tables, patterns and formats that results depend on."""

# Domains.
CATEGORIES = ("Billing", "Technical Support", "Refund", "Shipping", "Account", "Complaint", "Product Inquiry", "Cancellation")
PRIORITIES = ("Low", "Medium", "High", "Critical")
SOURCES = ("synthetic", "manual", "external")
DEPARTMENTS = {
    "Billing": "Billing Team",
    "Technical Support": "Technical Support Team",
    "Refund": "Refund Team",
    "Shipping": "Logistics Team",
    "Account": "Account Support Team",
    "Complaint": "Customer Care Team",
    "Product Inquiry": "Product Support Team",
    "Cancellation": "Retention Team",
}
DEFAULT_DEPARTMENT = "General Support Team"
MAX_TICKET_LENGTH, MIN_INCOMING, MAX_INCOMING = 5000, 5, 2000

# The fallback stop words without the eight interrogatives that carry intent.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be", "because", "been",
    "before", "being", "below", "between", "both", "but", "by", "can't", "cannot", "could", "couldn't", "did", "didn't", "do", "does",
    "doesn't", "doing", "don't", "down", "during", "each", "few", "for", "from", "further", "had", "hadn't", "has", "hasn't", "have", "haven't",
    "having", "he", "he'd", "he'll", "he's", "her", "here", "here's", "hers", "herself", "him", "himself", "his", "how's", "i", "i'd", "i'll",
    "i'm", "i've", "if", "in", "into", "is", "isn't", "it", "it's", "its", "itself", "let's", "me", "more", "most", "mustn't", "my", "myself",
    "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same",
    "shan't", "she", "she'd", "she'll", "she's", "should", "shouldn't", "so", "some", "such", "than", "that", "that's", "the", "their",
    "theirs", "them", "themselves", "then", "there", "there's", "these", "they", "they'd", "they'll", "they're", "they've", "this", "those",
    "through", "to", "too", "under", "until", "up", "very", "was", "wasn't", "we", "we'd", "we'll", "we're", "we've", "were", "weren't",
    "what's", "when's", "where's", "while", "who's", "why's", "with", "won't", "would", "wouldn't", "you", "you'd", "you'll", "you're",
    "you've", "your", "yours", "yourself", "yourselves",
)
# The short stop list of n-gram counts.
NGRAM_STOP_WORDS = (
    "i", "my", "the", "a", "an", "is", "to", "for", "and", "in", "of", "it", "me", "please", "this", "was", "with", "on", "have", "be", "you",
    "can", "not", "do", "at", "but", "that", "as", "are", "we", "they", "our", "from",
)
KEYBOARD_MASHES = ("asdf", "asdfghjkl", "qwertyuiop", "zxcvbnm", "poiuytrewq", "lkjhgfdsa", "mnbvcxz")

# Priority signals, patterns over the lower-cased text with their scores.
SIGNALS: dict[str, tuple[tuple[str, float], ...]] = {
    "urgency": (
        (r"\b(urgent|urgently|emergency|asap|immediate|immediately|crisis|critical|priority)\b", 0.9),
        (r"\b(jaldi|turant|ekdum|fatafat|zaroori|urgent\s+hai)\b", 0.9),
        (r"(તરત|જલ્દી|તાત્કાલિક|ઇમરજન્સી)", 0.9),
        (r"\b(plz\s+respond\s+asap|respond\s+asap|need\s+help\s+now|right\s+now|at\s+once)\b", 0.85),
        (r"\b(soon\s+as\s+possible|quick\s+update|please\s+hurry|hurry\s+up)\b", 0.6),
        (r"\b(plz\s+help|quick\s+question|can\s+you\s+help|looking\s+forward)\b", 0.2),
    ),
    "severity": (
        (r"\b(completely\s+broken|crash|crashing|fatal|unusable|destroyed|severe|critical\s+bug)\b", 0.95),
        (r"\b(kharab|kaam\s+nahi\s+kar\s+raha|chal\s+nahi\s+raha|band\s+hai)\b", 0.8),
        (r"(ક્રેશ|કામ\s*નથી\s*કરતું|બંધ\s*છે|ખરાબ)", 0.8),
        (r"\b(broken|corrupted|error\s+code|500\s+internal|failed\s+completely|dead)\b", 0.75),
        (r"\b(glitch|minor\s+issue|slow|intermittent|not\s+working\s+properly)\b", 0.4),
        (r"\b(inquiry|status|how\s+to|where\s+is|what\s+is)\b", 0.1),
    ),
    "financial_impact": (
        (r"\b(charged\s+twice|double\s+charge|unauthorized\s+charge|fraudulent\s+transaction|stolen\s+card|money\s+deducted)\b", 0.95),
        (r"\b(paise\s+kat\s+gaye|do\s+baar\s+(?:charge|kata|kat|kate|payment)|paisa\s+chori|galat\s+charge|card\s+charge)\b", 0.95),
        (r"(બે\s*વાર\s*પૈસા|પૈસા\s*કપાઈ|ખોટો\s*ચાર્જ|બે\s*વાર\s*ચાર્જ)", 0.95),
        (r"\b(refund|overcharged|payment\s+failed|billing\s+error|wrong\s+amount|invoice\s+issue)\b", 0.75),
        (r"\b(paise\s+wapas|refund\s+chahiye|charge\s+back)\b", 0.75),
        (r"(રિફંડ|પૈસા\s*પાછા)", 0.75),
        (r"\b(pricing|subscription|cost|receipt|estimate)\b", 0.3),
    ),
    "security_risk": (
        (r"\b(hacked|account\s+hacked|unauthorized\s+access|breach|compromised|data\s+leak)\b", 1.0),
        (r"\b(hack\s+ho\s+gaya|chori\s+ho\s+gaya|account\s+kisi\s+aur\s+ke\s+paas)\b", 1.0),
        (r"(હેક|હેક\s*થઈ|ચોરાઈ|એકાઉન્ટ\s*હેક)", 1.0),
        (r"\b(suspicious\s+activity|password\s+reset\s+without|phishing|stolen\s+credentials|impersonation)\b", 0.85),
        (r"\b(cannot\s+login|locked\s+out|blocked\s+account|2fa\s+failed|otp\s+issue)\b", 0.6),
        (r"\b(update\s+profile|change\s+email|update\s+password|profile\s+information)\b", 0.2),
    ),
    "service_impact": (
        (r"\b(entire\s+business|all\s+users|production\s+down|system\s+outage|total\s+downtime|enterprise\s+down)\b", 1.0),
        (r"\b(poora\s+system\s+down|sabka\s+band|server\s+down)\b", 0.9),
        (r"(આખી\s*સિસ્ટમ\s*ડાઉન|સર્વર\s*ડાઉન|બધું\s*બંધ)", 0.9),
        (r"\b(server\s+error|service\s+unavailable|api\s+down|database\s+connection\s+failed|gateway\s+timeout)\b", 0.8),
        (r"\b(single\s+feature|page\s+not\s+loading|unable\s+to\s+checkout|button\s+not\s+working)\b", 0.5),
        (r"\b(cosmetic|spelling|styling|general\s+feedback)\b", 0.1),
    ),
    "time_sensitivity": (
        (r"\b(today|within\s+an\s+hour|24\s+hours|deadline|immediately|by\s+tonight)\b", 0.9),
        (r"\b(aaj\s+hi|aaj\s+shaam\s+tak|abhi\s+ke\s+abhi|jaldi\s+se\s+jaldi)\b", 0.9),
        (r"(આજે\s*જ|તરત\s*જ|૨૪\s*કલાક)", 0.9),
        (r"\b(delayed\s+for\s+(?:two|several|\d+)\s+weeks|waiting\s+for\s+(?:weeks|months)|long\s+overdue)\b", 0.85),
        (r"\b(delayed\s+by\s+\d+\s+days|late\s+by\s+\d+\s+days|two\s+days\s+late|overdue)\b", 0.65),
        (r"\b(this\s+week|in\s+coming\s+days|no\s+rush|whenever\s+possible)\b", 0.2),
    ),
}
# Explanation phrases; per signal the thresholds, highest first, in order of mention.
REASONS: tuple[tuple[str, tuple[tuple[float, str], ...]], ...] = (
    ("security_risk", ((0.7, "critical security/credential risk"), (0.4, "account access concern"))),
    ("service_impact", ((0.7, "major system/service disruption"), (0.4, "service functionality limitation"))),
    ("financial_impact", ((0.8, "significant financial/unauthorized charge impact"), (0.5, "billing/refund inquiry"))),
    ("urgency", ((0.7, "high urgency demand"),)),
    ("time_sensitivity", ((0.7, "strict time sensitivity or severe delay"), (0.5, "delivery delay"))),
    ("severity", ((0.7, "severe system or component failure"),)),
)
ROUTINE = "Standard routine inquiry with no elevated urgency or risk signals."
ELEVATED = "Moderately elevated priority based on ticket context."

# Personal data detectors, in order of mention.
PII: tuple[tuple[str, str], ...] = (
    ("Email address detected", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("Phone number detected", r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("Credit card sequence detected", r"\b(?:\d[ -]*?){13,16}\b"),
    ("SSN pattern detected", r"\b\d{3}-\d{2}-\d{4}\b"),
)

# Masks of the template signature over lower-cased text, in order; then the phrases taken out.
MASKS: tuple[tuple[str, str], ...] = (
    (r"\$\d+(\.\d+)?", "<AMOUNT>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"(?i)\b(ERR_\w+|NULL_POINTER_EXC|SOCKET_TIMEOUT|AUTH_DENIED|0x[A-F0-9]+)\b", "<ERR>"),
    (r"(?i)\b(jan|feb|q1)\s+\d{4}\b", "<PERIOD>"),
    (r"(?i)pro-\d+", "<MODEL>"),
    (r"(?i)#[A-Za-z0-9_-]+|\b(?=.*\d)[A-Za-z0-9_-]{4,12}\b", "<ID>"),
    (r"\b\d+\b", "<NUM>"),
)
NOISE = (
    "please advise as soon as possible.",
    "thank you for your assistance.",
    "urgent attention required.",
    "contact me via email or phone.",
    "appreciate a quick update on this.",
    "kindly look into this matter promptly.",
    "looking forward to your prompt response.",
    "thanks for your help!",
    "looking forward to hearing back.",
    "plz respond asap.",
)
# Masks of the audit's template variant, which takes out the first seven phrases.
AUDIT_MASKS: tuple[tuple[str, str], ...] = (
    (r"\$\d+(\.\d+)?", "<AMT>"),
    (r"\b\d{4,}\b", "<ID>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"(?i)\b(ERR_\w+|NULL_POINTER_EXC|SOCKET_TIMEOUT|AUTH_DENIED)\b", "<ERR>"),
    (r"(?i)\b(Jan|Feb|Q1)\s+\d{4}\b", "<PERIOD>"),
    (r"(?i)PRO-\d+", "<MODEL>"),
)
AUDIT_NOISE = NOISE[:7]

# Language markers. A looks for substrings, B for whole words.
HINGLISH_PARTS = ("gaya", "ho", "mera", "hai", "karein", "chahiye", "karo", "nahi")
GUJARATI_PARTS = ("che", "thayo", "nathi", "karvu")
HINGLISH_WORDS = (
    "mera", "meri", "mere", "kahan", "hai", "mujhe", "karna", "karo", "apna", "apni", "kya", "nahi", "raha", "rahi", "kaise", "kab", "aur",
    "yeh", "woh", "bhai", "ji", "chahiye", "hoga", "gaya", "paise", "kat", "gaye", "baat", "samay", "jaldi", "madad",
)
TARGET_WORDS = ("parcel", "delivery", "shipping", "tracking", "refund", "charged", "urgent", "asap", "today", "hacked", "password", "account", "delayed", "missing", "broken")

# Triggers of the rule labels.
CRITICAL_TRIGGERS = (
    "unauthorized transaction", "unauthorized charge", "unrecognized login", "hacked", "fraud", "security breach", "account compromised",
    "database connection timeout", "server error 500", "system downtime", "outage during", "entire team has been unable",
    "lost access to the master", "service completely unavailable",
)
HIGH_TRIGGERS = (
    "missing for a week", "missing package for a week", "stuck in transit for a week", "delayed by a week", "express delivery",
    "significantly delayed", "locked and i cannot access", "cannot access important", "serious billing",
    "duplicate payment corrected urgently", "cancel subscription immediately", "immediately", "right now", "emergency", "lost permanently",
    "cannot access account", "business blocked", "urgent", "urgently", "asap",
)
MEDIUM_TRIGGERS = (
    "delayed by two days", "stuck in transit for several days", "refund has not arrived", "charged twice", "double charge",
    "duplicate charge", "double billing", "payment failed but money deducted", "auto renewal", "duplicate payment", "damaged", "crashes",
    "freezing", "locked",
)
LOW_TRIGGERS = (
    "discount", "documentation", "dark mode", "vat receipt", "tax invoice", "how can i", "how do i", "where to find", "macos",
    "compatible", "pricing details", "where is my parcel", "order status", "when my package will arrive", "tracking status",
    "question about my delivery", "delivery kab tak", "status update nathi",
)
URGENT_SUFFIXES = ("urgent attention required", "please advise as soon as possible")

# Replacements of the generator's noise, and the demo agents, two per department.
NOISE_WORDS = (
    ("please", "plz"), ("Please", "Plz"), ("you", "u"), ("You", "U"), ("your", "ur"), ("cannot", "cant"), ("does not", "doesnt"),
    ("with", "w/"), ("thanks", "thx"),
)
AGENTS = (
    ("Demo Agent A1", "Billing Team"),
    ("Demo Agent A2", "Billing Team"),
    ("Demo Agent B1", "Technical Support Team"),
    ("Demo Agent B2", "Technical Support Team"),
    ("Demo Agent C1", "Refund Team"),
    ("Demo Agent C2", "Refund Team"),
    ("Demo Agent D1", "Logistics Team"),
    ("Demo Agent D2", "Logistics Team"),
    ("Demo Agent E1", "Account Support Team"),
    ("Demo Agent E2", "Account Support Team"),
    ("Demo Agent F1", "Customer Care Team"),
    ("Demo Agent F2", "Customer Care Team"),
    ("Demo Agent G1", "Product Support Team"),
    ("Demo Agent G2", "Product Support Team"),
    ("Demo Agent H1", "Retention Team"),
    ("Demo Agent H2", "Retention Team"),
    ("Demo Agent I1", "General Support Team"),
    ("Demo Agent I2", "General Support Team"),
)

# Answers to requests, with what they name in braces.
MESSAGES = {
    "delete_no_id": "Ticket ID is required.",
    "deleted": "Ticket '{id}' deleted successfully.",
    "not_found": "Ticket '{id}' was not found.",
    "no_agents": "No active agents are available for department '{department}'. The ticket was not changed.",
    "only_agent": "Ticket '{id}' is already assigned to the only active agent in '{department}' and cannot be reassigned.",
    "assigned": "Ticket '{id}' assigned to {name}.",
    "feedback_no_id": "ticket_id is required.",
    "feedback_priority": "corrected_priority must be one of {listed}.",
    "feedback_unknown": "Ticket '{id}' not found.",
    "feedback_taken": "Priority feedback submitted successfully.",
    "flag_no_id": "feedback_id is required.",
    "flag_unknown": "Feedback '{id}' not found.",
    "flag_set": "Feedback '{id}' validation status updated to {flag}.",
    "empty_text": "Input ticket text cannot be empty.",
    "no_models": "Model artifacts not found or failed to load. Please train models first.",
}
# What the gate says.
GATE_EMPTY, GATE_NO_WORDS, GATE_VAGUE = "Please enter a ticket description.", "Please describe the issue using words.", "Please enter a meaningful description of the issue."
GATE_LONG = f"Please keep your ticket description under {MAX_TICKET_LENGTH} characters."

# What is detached from nouns and what takes its place, in the usual order.
NOUN_SUFFIXES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
