"""Word lists and patterns of the planning rules. \\b is an ASCII word boundary in all of them."""

from __future__ import annotations

# Signal patterns.
EXTERNAL_ACTORS = r"\b(users?|customers?|cto|cs|sales|trial|prospect|they|them)\b"
DESIRE_VERBS = r"\b(need|needs|require|requires|want|wants|requesting|asking for|screaming for)\b"
AMPLIFIERS = r"\b(blocker|failing|expansion)\b"
TIME_MILESTONE = r"\b(date|q[1-4]|launch|release|v1|\d+-week|\d+-day|\d+-month)\b"
SHIFT_VERBS = r"\b(push(?:ing|ed)?|delay(?:ing|ed)?|mov(?:e|ing|ed)|slip(?:ping|ped)?|pull(?:ing|ed)?)\b"
PLAN_CONDITIONAL = r"\b(if|unless|might|could|may)\b"
ACTIONABLE_CONDITIONAL = r"\b(if we don't|if we do not|if we can't|if we cannot|might need to be|could require|may force|might be pulled|could block)\b"
RISK_CONDITIONAL = r"\b(if|unless)\b"
CONSEQUENCES = r"\b(release|launch|rollout|scope|mobile app|pulled|app store|compliance|gdpr|partnership|dead\s+in\s+the\s+water|data\s+residency)\b"
SUBJECTIVE_CONCERN = r"^(some\s+(\w+\s+)?)?(concern|risk|worry|worried|fear)\s+that\b"
RISK_TOKENS = r"\b(risk|concern|pii|gdpr|compliance|security|vulnerability|exposure|blocker)\b"
PII = r"\bpii\b"
PII_PARTNERS = r"\b(logging|user\s+ids?)\b"
TIME_UNITS = r"\b\d+[\s-]?(sprint|week|day|month)s?\b"
FEATURE_ASK = r"\b(request(?:s|ed|ing)?\s+to|need\s+to\s+\w|needs?\s+to\s+(add|build|create|implement|improve|update)|users?\s+need\s+(better|to)|asks?\s+for|would\s+like\s+to)\b"
BUG_TOKENS = r"\b(failing|broken|latency|error|regression|crash|not behaving|doesn't work|does not work)\b"
BUG_CONDITIONAL = r"\b(if|might|could|may|risk|concern)\b"

# Section predicates.
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DATE = rf"(?:\d+(?:th|st|nd|rd)|{_MONTH}|(?:q[1-4]|quarter)|next\s+\w+|this\s+\w+)"
CONCRETE_DELTA = rf"\b\d+-(?:week|day|month|sprint|quarter)s?\b|\b\d+\s+(?:week|day|month|sprint|quarter)s?\b|\d+(?:th|st|nd|rd)?\s*[→>-]+\s*\d+(?:th|st|nd|rd)?|\bfrom\s+(?:the\s+)?{_DATE}\s+to\s+(?:the\s+)?{_DATE}|\b(?:moved?|pushed?|delayed?|postponed?|rescheduled?)\s+(?:to|until|from)\s+{_DATE}"
SCHEDULE_EVENT = r"\b(?:delay(?:ed|ing)?|launch(?:ed|ing)?|deploy(?:ed|ing|ment)?|release(?:d|ing)?|ship(?:ped|ping)?|eta|go-live|go\s+live|target\s+date|due\s+date|deadline|milestone)\b"
SPEC_HEADING = r"\b(scoring|prioriti[sz]ation|three[-\s]factor|eligibility|additionality|weighting|framework|system)\b"
SPEC_TOKENS = [r"\bscoring\b", r"\bprioritization\b", r"\bprioritisation\b", r"\bthree[-\s]factor\b", r"\beligibility\b", r"\badditionality\b", r"\bweighting\b", r"\bframework\b", r"\bsystem\b"]
SPEC_EXCLUSIONS = r"\b(deploy(?:ed|ing|ment)?|launch(?:ed|ing)?|eta|target\s+date|window|shipped|in\s+progress|complete[d]?)\b"
DATES = r"\b(january|february|march|april|may|june|july|august|september|october|november|december|\d{1,2}\/\d{1,2}|\d{4})\b"
METRICS = r"\b(\d+%|\d+x|\$\d+|arr|mrr|dau|mau|nps|okr)\b"
QUARTERS = r"\b(q[1-4]|h[12])\b"
VERSIONS = r"\b(v\d+|mvp|alpha|beta|ga|launch)\b"
LAUNCH_WORDS = r"\b(launch|rollout|ship|release|deploy|go-live)\b"
INITIATIVE_PHRASES = r"\b(?:launch|build|create|spin\s+up|rollout|shipt|deliver|implement)\s+\w+"

# Process noise.
NOISE = [r"\bwho\s+owns?\b", r"\bunclear\s+who\b", r"\bambiguity\s+around\b", r"\bambiguous\b", r"\bhandover\b", r"\bhand[-\s]over\b", r"\bsign.?off\b", r"\bfinal\s+qa\b", r"\bprocess\s+ownership\b", r"\bownership\s+(?:of|around|for|issue|question|ambiguity|gap|problem|concern)\b"]
OWNERSHIP = [r"\bowner\s*:\s*\S", r"\b(?:pm|engineering|product\s+manager|customer\s+success|cs|design|eng|qa|security|legal)\s+to\s+\w"]

# Redaction, in the order of use.
REDACTION = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[email]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[ssn]"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[card]"),
    (r"(?:\+\d{1,3}[\s-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", "[phone]"),
]

# Generic language and common words.
GENERIC = """improve optimize align streamline clarify enhance coordinate prioritize manage facilitate leverage synergize enable empower drive ensure support address
discuss review assess evaluate process communication stakeholders priorities efficiency operations alignment workflows collaboration productivity visibility transparency
accountability ownership outcomes deliverables resources bandwidth capacity synergy impact value""".split()
COMMON = """about after again also because before being both could does doing during each even every first from going good have having here into just know last like make
many more most much need only other over same should some such take than that their them then there these they thing this those through time very want well what when
where which while will with would your""".split()

# Belief dimensions in order; the last that matches wins. (dimension, keywords, subject words, label, confidence)
DIMENSIONS = [
    ("timeline", "deadline|date|schedule|timeline|postpone|delay|move|shift|week|month|quarter|release", "deadline|release|timeline", "plan_change", 0.7),
    ("scope", "scope|feature|add|remove|include|exclude|functionality|capability|requirement", "feature|scope|functionality", "plan_change", 0.7),
    ("ownership", "owner|owned|assign|responsible|lead|team|transfer|handoff", "owner|ownership|lead", "plan_change", 0.7),
    ("priority", "priority|prioritize|critical|urgent|important|p0|p1|high priority|low priority", "priority|urgent|critical", "plan_change", 0.7),
    ("dependency", "depends on|dependency|blocked by|blocks|requires|prerequisite|waiting for", "depends|blocked|requires", "plan_change", 0.7),
    ("risk", "risk|concern|issue|problem|challenge|blocker|mitigation", "risk|concern|issue", "plan_change", 0.6),
    ("status", "status|progress|complete|done|started|in progress|blocked|on track", "status|progress|complete", "status", 0.8),
    ("decision", "decided|decision|choose|chose|selected|picked|agreed|consensus", "decided|decision|choose", "plan_change", 0.8),
]
BEFORE = "was|were|previously|before|originally|old|current"
AFTER = "will be|now|new|updated|changed to|moving to|going to"
OTHER_CHANGE = "change|update|modify|adjust|revise"

# Section intent.
REQUEST_STEMS = ["please", "can you", "could you", "would you", "i want you to", "i'd like you to", "i would like you to", "i would really like you to", "we should", "we probably should", "should", "let's", "lets", "need to", "we need to", "maybe we need", "we may need to", "it would be good to", "asking for", "requested", "want to", "would like", "requirement"]
ACTION_VERBS = "add implement build create enable disable remove delete fix update change refactor improve support integrate adjust modify revise".split()
CHANGE_OPERATORS = ["move", "moving", "moved", "push", "pushing", "pushed", "delay", "delaying", "delayed", "slip", "slipping", "slipped", "bring forward", "bringing forward", "brought forward", "postpone", "postponing", "postponed", "deprioritize", "deprioritizing", "deprioritized", "prioritize", "prioritizing", "prioritized", "shift", "shifting", "shifted", "pivot", "pivoting", "pivoted", "reframe", "reframing", "reframed", "reprioritize", "reprioritizing", "reprioritized", "defer", "deferring", "deferred", "accelerate", "accelerating", "accelerated", "narrow", "narrowing", "narrowed", "expand", "expanding", "expanded", "refocus", "refocusing", "refocused", "adjust", "adjusting", "adjusted", "modify", "modifying", "modified", "revise", "revising", "revised", "take over", "taking over", "took over", "instead of", "now p0", "now p1", "now p2"]
STATUS_MARKERS = ["done", "shipped", "deployed", "released", "implemented", "merged", "blocked", "waiting on", "in progress"]
TASK_MARKERS = ["- [ ]", "todo:", "action:", "owner:"]
PRODUCT_NOUNS = "onboarding signup flow ui api integration pricing dashboard tracking analytics".split()
ACTIONABILITY_VERBS = ["add", "verify", "update", "share", "remove", "fix", "create", "build", "implement", "test", "review", "check", "ensure", "set up", "deploy", "migrate", "refactor", "integrate", "move", "send", "confirm", "finalize"]
HEDGED = ["we should", "we probably should", "maybe we need", "we may need to", "it would be good to", "let's", "lets"]
NEGATIONS = ["don't", "do not", "no need to", "not necessary to"]
CALENDAR = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "next week", "this week", "next month"]
COMMUNICATION = ["email", "send", "slack", "follow up", "reach out", "ping"]
MICRO_TASKS = ["rename file", "update doc link", "fix typo"]
ROLES = ["pm to", "cs to", "eng to", "design to", "designer to", "project manager to", "product manager to", "engineering to", "customer success to"]
DECISIONS = ["will be logged", "will be", "no near-term", "near-term", "revisit", "decided", "agreed", "approved"]
PM_REQUESTS = ["users need", "users struggle", "requires us to", "we should consider", "maybe we could", "suggestion:", "this will require", "friction around"]

# Ideas, modality, ranking.
STRATEGY = "strategy approach system framework prioritization scoring automation".split()
MECHANISMS = "introduce use extend calculate integrate automate parse upload layer".split()
CONSTRUCTS = ["photo upload", "ai parsing", "scoring model", "prioritization system"]
ASSERTIVE = [r"\b(we will|let's|agreed to|we decided to|we are going to)\b", r"\b(we're (going to|doing|building|shipping|creating))\b", r"\b(committed to|committing to)\b", r"\b(definitely|absolutely|certainly)\s+(will|going to|need)\b"]
SPECULATIVE = [r"\b(maybe|might|could|possibly|perhaps)\b", r"\b(we should (explore|consider|think about|look into))\b", r"\b(what if|how about|worth considering)\b", r"\b(if we decide|if we go with|depending on)\b", r"\b(would be nice|could be interesting)\b"]
ARTIFACTS = r"\b(cache|command|conversion|integration|connector|schema|metadata|rollback|precision|migration)\b"
BUILD_VERBS = r"\b(force|add|build|create|implement|cache|convert)\b"
MARKETING = r"\b(marketing blast|announcement|campaign|press)\b"
TOPIC_ANCHORS = ["new feature", "feature request", "project timeline", "internal operation", "cultural shift", "bug:", "risk:"]

# Implications of timeline beliefs.
TIMELINE_RISK = [r"\b(won't|can't|cannot|unlikely|impossible)\s+(make|hit|meet)\b", r"\b(will\s+)?(slip|delay|push|postpone)\b", r"\b(not\s+going\s+to|won't\s+be\s+ready)\b", r"\b(at\s+risk|in\s+jeopardy|behind\s+schedule)\b", r"\b(probably|likely)\s+\d+\s*(weeks?|months?|days?)\s+(late|behind)"]
TIMELINE_PULL_IN = [r"\b(ahead\s+of\s+schedule|early|sooner)\b", r"\b(can\s+ship|ready\s+to\s+ship)\s+(earlier|sooner|before)", r"\b(pull\s+in|move\s+up|accelerate)\b"]
TIMELINE_UNCERTAIN = [r"\b(might|may|could|possibly)\s+(slip|delay)\b", r"\b(not\s+sure|unclear|uncertain)\s+(about|if|whether).*\b(date|timeline|schedule)\b", r"\b(depends\s+on|contingent\s+on)\b"]

# What is no work on initiatives, and what makes it work after all.
OFF_TOPIC = {
    "communication": [
        r"\b(send|email|share|notify|announce|communicate|forward|cc|bcc)\b.*\b(summary|notes|update|team|everyone)\b",
        r"\b(send|share)\s+(the|this|a)?\s*(summary|notes|recap)",
        r"\bemail\s+(the|this|a)?\s*(team|group|everyone)",
        r"\bnotify\s+(the|this|a)?\s*(stakeholder|team|manager)",
    ],
    "research": [
        r"\b(interview|survey|experiment|a\/b test|user research)\b",
        r"\bdo\s+(some|more)?\s*(research|interviews|testing)",
        r"\bvalidate\s+(this|the|our)\s*(assumption|hypothesis)",
        r"\btest\s+(this|the)\s*(idea|concept|approach)",
    ],
    "calendar": [
        r"\b(schedule|book|set up|find time|calendar)\s+(a|the)?\s*(meeting|call|sync|chat|room)",
        r"\bbook\s+(a|the)?\s*(room|space|venue)",
        r"\bput\s+(it|this)\s+(on|in)\s+(the|my|our)?\s*calendar",
        r"\bblock\s+(off|out)?\s*(time|calendar)",
        r"\brecurring\s+(meeting|sync|standup)",
    ],
    "hygiene": [
        r"\b(remember to|keep in mind|don't forget|note to self)\b",
        r"\b(follow up|touch base|check in)\b(?!\s+(on|about|regarding)\s+\w+\s+(initiative|project|work))",
        r"\bstay\s+(on top of|aligned|in sync)",
        r"\bmake sure\s+(to|we)\s*(remember|don't forget)",
    ],
}
CONCRETE = r"\b(owner|lead|responsible|by|due|deadline|scope|deliver|goal|outcome)\b"

# Cues of changes and of new work, with what they add to the confidence.
CHANGE_CUES = [
    ("mutation_timeline", 0.2, [
        r"\b(push|delay|postpone|move|shift|slip|extend)\s+.{0,30}(to|by|until)\s+(q[1-4]|next|end of|january|february|march|april|may|june|july|august|september|october|november|december)",
        r"\b(push|delay|postpone|move|shift|slip|extend)\s+(to|by|until|back)",
        r"\b(pull in|move up|bring forward|accelerate)\s+.{0,20}(to|by)",
        r"\b(new|updated|revised)\s+(deadline|due date|target date|timeline|eta)",
        r"\b(deadline|due date|release|timeline)\s+(is|changed to|moved to|now|pushed to|delayed to)\s+",
        r"\b(end of|by)\s+(q[1-4]|january|february|march|april|may|june|july|august|september|october|november|december)",
        r"\bto\s+(q[1-4])\s+(\d{4})?\b",
    ]),
    ("mutation_scope", 0.15, [
        r"\b(expand|extend|add|include|grow)\s+(the)?\s*(scope|work|feature)",
        r"\b(cut|remove|drop|descope|reduce)\s+(the)?\s*(scope|feature|requirement)",
        r"\b(scope|feature)\s+(creep|change|expansion)",
        r"\b(add|include|remove)\s+.{3,30}\s+(from|to)\s+(the)?\s*(scope|initiative|project)",
        r"\b(no longer|not going to)\s+(include|do|deliver|build)",
    ]),
    ("mutation_priority", 0.2, [
        r"\b(now|is|becomes?)\s+(top|highest|high|critical|p0|p1)\s*priority",
        r"\b(deprioritize|lower priority|de-prioritize|back burner)",
        r"\b(priority|prioritize)\s+(is|changed|moved|shifted)",
        r"\b(raise|increase|bump up|elevate)\s+(the)?\s*priority",
        r"\b(more|less)\s+(urgent|important|critical)\s+(than|now)",
        r"\bafter\s+.{3,30}\s+(is done|ships|launches)",
    ]),
    ("mutation_ownership", 0.2, [
        r"\b(will|going to|should)\s+(own|lead|drive|take over|take on)",
        r"\b(hand off|handoff|transfer|pass)\s+(to|ownership)",
        r"\b(new|changed)\s*(owner|lead|driver|responsible|point person)",
        r"\b(take|taking)\s+(over|on|ownership)",
        r"\b(assign|assigned|reassign|reassigned)\s+(to|from)",
    ]),
    ("mutation_status", 0.15, [
        r"\b(pause|pausing|paused|halt|halted|stop|stopped)\s+(the|this)?\s*(initiative|project|work)",
        r"\b(resume|resuming|restart|restarting|unpause)\s+(the|this)?\s*(initiative|project|work)",
        r"\b(done|complete|completed|finished|shipped|launched)",
        r"\b(cancel|cancelled|kill|killed|abandon|abandoned)",
        r"\b(activate|activated|start|started|kick off|kicked off)",
    ]),
]
NEW_CUES = [
    ("new_initiative", 0.3, [
        r"\b(we should spin up|need to spin up|let's spin up)\b",
        r"\b(this deserves its own initiative)\b",
        r"\b(let's track this as a project)\b",
        r"\b(we need a proper initiative for)\b",
        r"\b(we will (create|start|launch|kick off))\s+(a\s+new|an?\s*|new\s*)?(initiative|project|workstream)",
        r"\b(let's (create|start|launch|kick off))\s+(a\s+new|an?\s*|new\s*)?(initiative|project|workstream)",
        r"\b(agreed to (create|start|launch|spin up))\s+(a\s+new|an?\s*|new\s*)?(initiative|project)",
    ]),
    ("new_initiative", 0.25, [
        r"\b(we will track|let's track|tracking)\s+(this|as|a|an)\s*(initiative|project|item)",
        r"\b(make|turn)\s+(this|it)\s+(into)?\s*(a|an)?\s*(project|initiative)",
        r"\b(add|adding)\s+(this\s+)?to\s+(the)?\s*(backlog|roadmap)\b",
        r"\bnew\s+(initiative|project|workstream|effort)\s*:\s*",
    ]),
    ("decision", 0.2, [
        r"\b(we|team)\s+(decided|agreed)\s+(to|that)\s+(create|build|launch|ship|start)",
        r"\bdecision\s*:\s*(create|build|launch|ship|start)",
        r"\b(final decision|agreed)\s*:\s*(we (will|are going to))",
    ]),
    ("backlog_item", 0.15, [
        r"\b(add|create|file)\s+(a|an)?\s*(ticket|issue|task)\s*(for|to track)\b",
        r"\b(needs to be|should be)\s+(tracked|on the board|in the backlog)",
    ]),
    ("checklist", 0.1, [
        r"\b(checklist|action items)\s*(:|for)",
        r"\b(steps|tasks)\s+(to|before)\s+(launch|release|ship)",
    ]),
]

# Explicit asks, their order, and sentences that only look like them.
WORK_VERBS = ["add", "implement", "build", "create", "support", "enable", "integrate", "remove", "deprecate", "fix", "improve", "explore", "update", "change", "refactor"]
WE_COULD_VERBS = r"\b(?:add|cache|implement|build|create|enable|convert|force|support|integrate|improve|expose|generate)\b"
WANTED_ARTIFACTS = r"\b(?:command|button|integration|cache|rollback|docs?|documentation|template|dashboard|report|export|workflow|api|endpoint|flag|option|feature|tool|view|page|screen|modal|tab)\b"
EXPLICIT_REQUESTS = [
    r"\basksfor\b",
    r"\basks?\s+for\b",
    r"\brequest(?:s|ed)?\s+(?:to|for|that|a|an)\b",
    r"\bwould\s+like\b",
    r"\b(?:we|users?|teams?)\s+needs?\s+to\b",
    r"\b(?:we|users?|teams?)\s+needs?\s+(?:a|an|the|better|improved?|faster|more)\b",
    r"\b(?:we|they|users?|teams?)\s+wants?\s+to\b",
    r"\b(?:we|they|users?|teams?)\s+wants?\s+(?:a|an|the|better|improved?|faster|more)\b",
    r"\bwe\s+should\b",
    r"\bmaybe\s+we\s+could\b",
    r"\brequires\s+us\s+to\b",
    r"\bthis\s+will\s+require\b",
    r"\bsuggestion:",
    r"\brequirement(?:s)?(?:\s+to|\s*:)?\s+implement\b",
]
PRIORITY_STATUS = [r"\bis\s+(?:now\s+)?(?:a\s+)?high-priority(?:\s+item)?(?:\s+for)?\b", r"\bis\s+(?:a\s+)?(?:high|top|low)\s+priority\b", r"\bfor\s+the\s+(?:h\d|q\d)\s+roadmap\b", r"\bfor\s+the\s+roadmap\b", r"\btop\s+priority\s+for\b", r"\bpriority\s+item\b"]
CONCERNS = [r"\bconcern\s+that\b", r"\brisk\s+that\b", r"\bworried\s+that\b", r"\bmight\s+churn\b", r"\bcould\s+churn\b", r"\bmight\s+impact\b", r"\bcould\s+cause\b"]
ASK_MARKERS = [r"\brequirement(?:s)?\s+to\b", r"\brequest(?:s|ed)?\s+to\b", r"\b(?:we|users?|teams?)\s+needs?\b", r"\basks?\s+for\b"]
REMOVAL_VERBS = r"\b(pull|remove|de-scope|descope|delay|postpone|exclude)\b"
MARKET_ARTIFACTS = r"\b(marketing blast|launch|announcement|press|campaign|release)\b"
META_VERBS = ["prioritize", "review", "discuss", "align", "evaluate", "assess", "revisit", "brainstorm", "sync", "follow up", "consider", "coordinate", "validate", "confirm"]
CONCRETE_VERBS = ["add", "implement", "build", "create", "enable", "support", "integrate", "remove", "deprecate", "fix", "improve", "migrate", "launch", "ship"]
CONCRETE_NOUNS = ["feature", "integration", "ui", "api", "role", "permission", "dashboard", "report", "export", "onboarding", "workflow", "portal", "gating", "schema", "mapper", "endpoint", "component", "service", "migration", "webhook"]
