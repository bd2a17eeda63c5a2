"""Word lists and patterns of the cleaning and extraction rules.

Patterns are written so that Java, RE2 and Python read them alike: a word character is any letter, digit or underscore
(WORD), white space is WS, and a line break is the only thing a dot does not match.
"""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]"
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[\\s", "[^\\s")

# Fillers, in the order in which they are tried.
FILLERS = [
    "um", "uh", "uhm", "er", "ah", "oh", "eh", "mm", "hmm", "hm",
    "you know", "i mean", "like", "so", "well", "okay", "right",
    "basically", "actually", "literally", "honestly", "obviously",
    "sort of", "kind of", "i guess", "let me see", "let's see",
]

# Patterns removed one after the other, case ignored.
TIMESTAMPS = [
    r"\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}\s*-->\s*\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}",
    r"\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}",
    r"\[\d{1,2}:\d{2}:\d{2}\]",
    r"<\d{1,2}:\d{2}:\d{2}>",
    r"\btimestamp:\s*\d+",
    r"\d+\s*\n\d{2}:\d{2}:\d{2}",
]
NOISE = [r"SPEAKER_?\d+:?", r"Speaker\s*\d+:?", r"spk_?\d+:?", r"S\d+:?", r"Unknown\s*Speaker:?", r"Male\s*Voice:?", r"Female\s*Voice:?"]
ARTIFACTS = [r"\[.*?\]", r"\(.*?\)", r"<.*?>", r"\*.*?\*", r"--+", r"\.{3,}", r"\?{2,}", r"!{2,}"]

# Spelled numbers and ordinals.
NUMBERS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18",
    "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
    "hundred": "100", "thousand": "1000", "million": "1000000",
}
ORDINALS = {
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th",
}

# Words that mark actions, priorities and roles.
ACTION_VERBS = [
    "complete", "submit", "review", "finalize", "prepare", "send", "follow up", "discuss", "present", "resolve", "update", "schedule",
    "assign", "plan", "organize", "check", "remind", "investigate", "implement", "create", "develop", "test", "deploy", "fix",
    "coordinate", "confirm", "validate", "approve", "analyze",
]
MODALS = ["need to", "have to", "must", "should", "ought to", "required to", "supposed to", "going to", "will", "shall"]
ASSIGNMENTS = ["responsible for", "in charge of", "assigned to", "delegated to", "tasked with", "accountable for", "owns", "leads"]
PRIORITIES = {
    "high": [
        r"\b(asap|urgent|critical|emergency|immediate|priority|rush)\b",
        r"\b(today|by end of day|eod|this morning)\b",
        r"\b(red flag|blocker|critical path)\b",
    ],
    "medium": [
        r"\b(should|need to|important|soon|this week)\b",
        r"\b(by friday|end of week|next few days)\b",
        r"\b(follow up|check in|review)\b",
    ],
    "low": [
        r"\b(can|might|could|optional|when possible|if time permits)\b",
        r"\b(nice to have|eventually|someday|future)\b",
        r"\b(low priority|back burner)\b",
    ],
}
PRIORITY_LEVELS = ["high", "medium", "low", "unspecified"]
ROLES = {
    "manager": r"\b(manager|director|lead|supervisor|head of|ceo|cto|cfo)\b",
    "developer": r"\b(developer|engineer|programmer|coder|dev)\b",
    "designer": r"\b(designer|ui|ux|creative)\b",
    "analyst": r"\b(analyst|data scientist|researcher)\b",
    "coordinator": r"\b(coordinator|organizer|admin|assistant)\b",
    "consultant": r"\b(consultant|advisor|specialist|expert)\b",
}
TEXT_EXTENSIONS = ["txt", "srt", "vtt"]
AUDIO_EXTENSIONS = ["mp3", "wav", "m4a", "webm", "flac", "ogg"]

#: Our own short list, used wherever stop words are left out.
STOP_WORDS = """a about after all also an and any are as at be because been before but by can could did do does for from had has have he her
him his how i if in into is it its just me more most my no not of on one or other our out over she should so some than that the their them then
there these they this those through to too under up us very was we were what when where which while who why will with would you your""".split()

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
