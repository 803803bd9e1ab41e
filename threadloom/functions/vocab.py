"""Fixed vocabularies and rule tables of the support domain; every operator takes its own table as a parameter instead."""

# The vocabularies, in order.
INTENTS = (
    "Playback reliability",
    "App, device, and platform behavior",
    "Content or catalog availability",
    "Playlist, library, and music organization",
    "Premium, subscription, and plan status",
    "Billing, payment, refund, and card issues",
    "Account access, identity, and security",
    "Family and student eligibility",
    "Downloads and offline listening",
    "Ads and free-tier experience",
)
STATES = (
    "SYMPTOM_REPORTED",
    "CONTEXT_COLLECTED",
    "FIRST_LINE_ACTION_PROPOSED",
    "ACTION_RESULT_REPORTED",
    "REPEATED_FAILURE_OR_BROADER_INCIDENT",
    "PRIVATE_ACCOUNT_CONTEXT_REQUIRED",
    "SPECIALIST_OR_PRODUCT_INVESTIGATION",
    "RESOLVED",
    "MONITORING",
)
ACTIONS = (
    "ASK_PLATFORM_CONTEXT",
    "ASK_SYMPTOM_EVIDENCE",
    "ASK_SCOPE_OR_ENVIRONMENT",
    "ASK_CATALOG_CONTEXT",
    "SESSION_RESET",
    "REINSTALL_OR_CLEAN_INSTALL",
    "BROWSER_REMEDIATION",
    "NETWORK_REMEDIATION",
    "PROVIDE_HELP_RESOURCE",
    "REQUEST_SECURE_ACCOUNT_DETAILS",
    "MOVE_TO_DM_OR_SECURE_CHANNEL",
    "ESCALATE_TECHNICAL_OR_PRODUCT_ISSUE",
    "CONFIRM_AND_MONITOR",
)
REQUIREMENTS = ("PLATFORM_CONTEXT", "SYMPTOM_EVIDENCE", "SCOPE_OR_ENVIRONMENT", "CATALOG_CONTEXT", "SECURE_ACCOUNT_CONTEXT", "PRIOR_ATTEMPTS_AND_TIMING")
REQUIREMENT_STATUSES = ("missing", "present", "conflicting", "private", "unknown", "not_required")
ACTION_RESULTS = ("attempted", "failed", "partially_helped", "improved", "resolved", "unknown")
EXPLICITNESS = ("explicit", "inferred", "ambiguous")
RECONSTRUCTION_STATUSES = ("complete", "partial", "uncertain")
EVIDENCE_STRENGTHS = ("strong", "moderate", "weak", "conflicting", "insufficient")
REASON_CODES = {
    "PRIVATE_ACCOUNT_CONTEXT": "private account context is required",
    "SECURITY_OR_ACCOUNT_ACCESS": "account or security handling is high risk",
    "BILLING_PAYMENT_OR_REFUND": "billing or payment handling is high risk",
    "REPEATED_FAILURE_OR_RELAPSE": "prior troubleshooting has repeatedly failed",
    "BROADER_INCIDENT": "the evidence suggests a broader incident",
    "SPECIALIST_OR_PRODUCT_INVESTIGATION": "specialist or product investigation is required",
    "INSUFFICIENT_EVIDENCE": "there is insufficient evidence for safe automation",
    "CONFLICTING_EVIDENCE": "available evidence conflicts",
    "HISTORICAL_POLICY_OR_CATALOG_LIMITATION": "historical evidence cannot establish current policy or catalog truth",
    "OTHER_HIGH_RISK": "no safe automated action is available",
}
LABEL_STATUSES = ("labelled", "ambiguous", "insufficient_evidence", "unlabelled")
OUTCOMES = ("resolved", "monitoring_or_improved", "unresolved", "escalated_or_handoff", "dm_ended", "unknown")
ELIGIBILITY = ("yes", "no", "uncertain")
VISIBILITY = ("visible", "partial", "dm_ended", "unknown")
CONFIDENCE = ("high", "medium", "low")
JUDGE_DIMENSIONS = ("groundedness", "action_alignment", "relevance", "safety", "clarity", "escalation_appropriateness")

# Phrases and their weights by intent.
INTENT_RULES = {
    "Playback reliability": {"playback": 3, "skip": 3, "skips": 3, "skipping": 3, "stutter": 3, "pause": 2, "buffer": 2, "won't play": 3, "not playing": 3},
    "App, device, and platform behavior": {"app": 2, "browser": 2, "crash": 3, "battery": 3, "ios": 2, "android": 2, "device": 1, "platform": 2},
    "Content or catalog availability": {"artist": 2, "album": 2, "song": 2, "track": 2, "unavailable": 3, "greyed": 3, "catalog": 3, "removed": 2},
    "Playlist, library, and music organization": {"playlist": 3, "library": 3, "shuffle": 2, "repeat": 2, "organize": 2, "local file": 2, "save": 1},
    "Premium, subscription, and plan status": {"premium": 3, "subscription": 3, "trial": 2, "upgrade": 2, "plan status": 3},
    "Billing, payment, refund, and card issues": {"charged": 3, "charge": 2, "payment": 3, "card": 3, "refund": 3, "billing": 3},
    "Account access, identity, and security": {"log in": 3, "login": 3, "sign in": 3, "password": 3, "hacked": 4, "account access": 4, "changed my email": 4},
    "Family and student eligibility": {"family": 3, "student": 3, "verification": 2, "invite": 2, "eligibility": 3},
    "Downloads and offline listening": {"download": 3, "offline": 3, "downloaded": 3},
    "Ads and free-tier experience": {"ad": 2, "ads": 3, "advert": 3, "commercial": 3, "free tier": 3},
}

# A pattern per action, in order of preference; {product} stands for the product's name.
ACTION_PATTERNS = {
    "ASK_PLATFORM_CONTEXT": r"device|operating system|\bios\b|android|ios|app version|{product} version",
    "ASK_SYMPTOM_EVIDENCE": r"error message|screenshot|what happens|exact symptom",
    "ASK_SCOPE_OR_ENVIRONMENT": r"another device|different device|another browser|incognito|other artist|wifi|wi-fi|3g|4g|cellular",
    "ASK_CATALOG_CONTEXT": r"song link|song uri|track link|country is your account|catalog",
    "SESSION_RESET": r"log ?out|log ?in|restart|re-?start",
    "REINSTALL_OR_CLEAN_INSTALL": r"reinstall|clean install|uninstall",
    "BROWSER_REMEDIATION": r"clear (?:the )?cache|clear cookies|supported browser|another browser|incognito",
    "NETWORK_REMEDIATION": r"restart (?:the )?connection|try another network|wifi|wi-fi|cellular|mobile data",
    "PROVIDE_HELP_RESOURCE": r"https?://|help page|help link|support article",
    "REQUEST_SECURE_ACCOUNT_DETAILS": r"username|email address|account details|account email",
    "MOVE_TO_DM_OR_SECURE_CHANNEL": r"\bdm\b|direct message|private message|secure channel",
    "ESCALATE_TECHNICAL_OR_PRODUCT_ISSUE": r"developer|technical team|tech team|investigat|passed .* feedback",
    "CONFIRM_AND_MONITOR": r"glad to hear|if it happens again|keep an eye|monitor|let us know if",
}
OWN_ATTEMPT = r"\b(i|we) (tried|did|used)"

# What a reply says of an attempted action; the first that matches counts.
RESULT_PATTERNS = {
    "failed": r"\b(no luck|still (?:not|no|doesn|does not|won)|didn['’]?t help|did not help|nothing changed|neither worked|doesn['’]?t work|does not work|won['’]?t work|problem persists)\b",
    "resolved": r"\b(fixed|resolved|working now|works now|it works|solved)\b",
    "improved": r"\b(better|improved|seems to have worked|working so far|partially)\b",
}

# Patterns behind the state decisions.
STATE_PATTERNS = {
    "failure": r"\b(no luck|didn['’]?t help|nothing changed|still (?:doesn['’]?t|not|no)|won['’]?t work|doesn['’]?t work|neither worked)\b",
    "investigation": r"developer|technical team|tech team|investigat|passed .* feedback",
    "private_channel": r"\b(dm|direct message|private|secure)\b",
    "account_word": r"username|email|account",
    "access_risk": r"\b(hacked|password|account access|can['’]?t log ?in|cannot log ?in)\b",
    "resolved": r"\b(fixed|resolved|working now|works now|it works|solved)\b",
    "improving": r"\b(seems to have worked|working so far|monitor|if it happens again|improved)\b",
    "result": r"\b(worked|helped|better|still|again)\b",
    "proposal": r"\b(try|restart|reinstall|clear cache|log out|log in|another browser|another device|help link)\b",
    "platform": r"device|phone|computer|desktop|iphone|android|browser|chrome|linux|windows|mac",
    "symptom": r"error|screenshot|crash|skip|pause|stutter|greyed|unavailable|not working|won['’]?t work",
    "diagnostic": r"device|operating system|\bios\b|android|browser|version|screenshot|error|wifi|network|country|song link|uri",
}

# Markers of single messages.
MARKERS = {
    "failure_marker_flag": r"\b(no luck|still(?: not| no| having)|didn['’]?t help|did not help|nothing changed|neither worked|won['’]?t work|doesn['’]?t work|still happens|problem persists|cannot|can't)\b",
    "question_marker_flag": r"\?|\b(?:what|which|where|when|how|can you|could you|are you)\b",
    "diagnostic_context_marker_flag": r"\b(?:device|operating system|\bios\b|\bandroid\b|version|browser|screenshot|error message|wifi|wi-fi|cellular|3g|4g|network|country|song link|song uri|username|email address|what .* version)\b",
    "dm_handoff_marker_flag": r"\b(?:dm|direct message|private message|secure|username|email address)\b",
    "resolution_marker_flag": r"\b(?:fixed|resolved|working now|works now|it works|worked|solved|glad to hear|thank(?:s| you).*(?:worked|helped|fixed))\b",
}

# Dimensions of the action score.
REQUIREMENT_ACTIONS = {
    "PLATFORM_CONTEXT": ("ASK_PLATFORM_CONTEXT",),
    "SYMPTOM_EVIDENCE": ("ASK_SYMPTOM_EVIDENCE",),
    "SCOPE_OR_ENVIRONMENT": ("ASK_SCOPE_OR_ENVIRONMENT",),
    "CATALOG_CONTEXT": ("ASK_CATALOG_CONTEXT",),
    "SECURE_ACCOUNT_CONTEXT": ("REQUEST_SECURE_ACCOUNT_DETAILS", "MOVE_TO_DM_OR_SECURE_CHANNEL"),
    "PRIOR_ATTEMPTS_AND_TIMING": ("ASK_SYMPTOM_EVIDENCE",),
}
STATE_ACTIONS = {
    "SYMPTOM_REPORTED": ("ASK_PLATFORM_CONTEXT", "ASK_SYMPTOM_EVIDENCE", "ASK_SCOPE_OR_ENVIRONMENT", "ASK_CATALOG_CONTEXT"),
    "CONTEXT_COLLECTED": ("SESSION_RESET", "REINSTALL_OR_CLEAN_INSTALL", "BROWSER_REMEDIATION", "NETWORK_REMEDIATION", "PROVIDE_HELP_RESOURCE"),
    "FIRST_LINE_ACTION_PROPOSED": ("CONFIRM_AND_MONITOR", "ASK_SYMPTOM_EVIDENCE"),
    "ACTION_RESULT_REPORTED": ("REINSTALL_OR_CLEAN_INSTALL", "ASK_SCOPE_OR_ENVIRONMENT", "MOVE_TO_DM_OR_SECURE_CHANNEL", "ESCALATE_TECHNICAL_OR_PRODUCT_ISSUE"),
    "REPEATED_FAILURE_OR_BROADER_INCIDENT": ("ESCALATE_TECHNICAL_OR_PRODUCT_ISSUE", "MOVE_TO_DM_OR_SECURE_CHANNEL", "REQUEST_SECURE_ACCOUNT_DETAILS"),
    "PRIVATE_ACCOUNT_CONTEXT_REQUIRED": ("MOVE_TO_DM_OR_SECURE_CHANNEL", "REQUEST_SECURE_ACCOUNT_DETAILS"),
    "SPECIALIST_OR_PRODUCT_INVESTIGATION": ("ESCALATE_TECHNICAL_OR_PRODUCT_ISSUE", "CONFIRM_AND_MONITOR"),
    "RESOLVED": ("CONFIRM_AND_MONITOR",),
    "MONITORING": ("CONFIRM_AND_MONITOR",),
}
INTENT_ACTIONS = {
    ("Content or catalog availability", "ASK_CATALOG_CONTEXT"): 3.0,
    ("Billing, payment, refund, and card issues", "REQUEST_SECURE_ACCOUNT_DETAILS"): 3.0,
    ("Billing, payment, refund, and card issues", "MOVE_TO_DM_OR_SECURE_CHANNEL"): 2.0,
    ("Account access, identity, and security", "REQUEST_SECURE_ACCOUNT_DETAILS"): 3.0,
    ("Account access, identity, and security", "MOVE_TO_DM_OR_SECURE_CHANNEL"): 2.0,
    ("Family and student eligibility", "REQUEST_SECURE_ACCOUNT_DETAILS"): 2.0,
    ("Family and student eligibility", "MOVE_TO_DM_OR_SECURE_CHANNEL"): 2.0,
    ("Downloads and offline listening", "PROVIDE_HELP_RESOURCE"): 1.0,
}
PROGRESSION = (
    ("REPEATED_FAILURE_OR_BROADER_INCIDENT", "PRIVATE_ACCOUNT_CONTEXT_REQUIRED", "SPECIALIST_OR_PRODUCT_INVESTIGATION"),
    ("REQUEST_SECURE_ACCOUNT_DETAILS", "MOVE_TO_DM_OR_SECURE_CHANNEL", "ESCALATE_TECHNICAL_OR_PRODUCT_ISSUE"),
)

# Reply texts; {product} stands for the product's name.
REPLIES = {
    "ASK_PLATFORM_CONTEXT": "Could you let us know which device and operating system you're using, along with your {product} app or browser version? That will help us narrow this down.",
    "ASK_SYMPTOM_EVIDENCE": "Could you share the exact error or what happens when the issue occurs? A screenshot would also help if one is available.",
    "ASK_SCOPE_OR_ENVIRONMENT": "Does this happen on another device, browser, network, or with another artist as well? That comparison will help us narrow the cause.",
    "ASK_CATALOG_CONTEXT": "Could you send us the song or album link and tell us which country your account is set to? That will help us check the availability context.",
    "SESSION_RESET": "Please log out, restart the device, and sign back in, then let us know whether the issue changes.",
    "REINSTALL_OR_CLEAN_INSTALL": "Please try a clean reinstall using {product}'s official support steps, then let us know whether the issue remains.",
    "BROWSER_REMEDIATION": "Please try another supported browser or an incognito window, and clear the browser cache and cookies if the issue continues.",
    "NETWORK_REMEDIATION": "Could you compare the behavior on another network, such as mobile data versus Wi-Fi? That will help us narrow the connection path.",
    "PROVIDE_HELP_RESOURCE": "Please follow the relevant {product} support steps for this issue and let us know which step you were able to try and what changed.",
    "REQUEST_SECURE_ACCOUNT_DETAILS": "Please send the requested account details through DM rather than posting them publicly so we can keep them private.",
    "MOVE_TO_DM_OR_SECURE_CHANNEL": "Could you continue with us in DM or the secure support channel? We need to keep the account-specific details private.",
    "ESCALATE_TECHNICAL_OR_PRODUCT_ISSUE": "We have enough visible context to pass this to the technical or product team for investigation. We cannot confirm a fix yet, but the troubleshooting history will help with the handoff.",
    "CONFIRM_AND_MONITOR": "Thanks for confirming. Please keep an eye on it and let us know if the issue comes back.",
}
PRIVATE_REPLY = "This needs account-specific handling, so please continue with us through DM or the secure support channel. Please do not post account, payment, or security details publicly."
REVIEW_REPLY = "This needs human or specialist review because the visible troubleshooting evidence is not sufficient for safe automated handling. We will pass the case context to the appropriate support team without claiming a resolution."
REPLY_GUARDS = {
    r"\bguarantee\w*\b|\bdefinitely\b|\bwill be fixed\b": "contains an unsupported guarantee",
    r"\b(refund|chargeback)\b.*\b(approved|issued|processed)\b": "claims a financial outcome",
    r"\bwe (fixed|resolved)\b": "claims a resolution not established by the case",
    r"\b(account|email|username)\s*[:=]": "exposes account data in the draft",
}

# Targets of the stratified sample.
LENGTH_TARGETS = {"single_turn": 72, "short_multi_turn": 60, "medium_multi_turn": 60, "long_multi_turn": 48}
SECONDARY_TARGETS = {
    "reconstruction_status": {"complete": 210, "partial": 30},
    "failure_marker": {"true": 50},
    "dm_handoff_marker": {"true": 60},
    "resolution_marker": {"true": 30},
    "diagnostic_context_marker": {"true": 60},
    "question_marker": {"true": 190},
}
