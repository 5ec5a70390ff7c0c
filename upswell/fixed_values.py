"""Results depend on them, so they are stated as plain text."""

from __future__ import annotations

# The terminal states of a tag.
CANON_LITE = "canon_lite"
CANON_FLASH = "canon_flash"
DEMOTED = "demoted"
PENDING = "pending"
STATUSES = (CANON_LITE, CANON_FLASH, DEMOTED, PENDING)
CONFIRMED = (CANON_LITE, CANON_FLASH)
UNRESOLVED = (PENDING, DEMOTED)

# Model slots and their free calls per day.
LITE_MODEL = "gw-gemma"
FLASH_MODEL = "gw-flash"
DAILY_QUOTA = {LITE_MODEL: 1500, FLASH_MODEL: 250}

# Thresholds and batch sizes.
CONFIDENCE_THRESHOLD = 0.80
ESCALATION_CAP = 100
TAG_BATCH = 20
TEXT_BATCH = 64
WORK_LIMIT = 500
TOP_N = 15
CLUSTER_MIN_SONGS = 6
MIN_WEEKS = 2
PAGE_SIZE = 50
MAX_PAGES = 40

# Service names as they appear in the landed song documents.
NICO_SERVICE = "NicoNicoDouga"
YOUTUBE_SERVICE = "Youtube"
METRIC_SOURCE = "niconico"

# The starting vocabulary of canonical terms.
SEED_VOCAB = (
    "Rock", "Alternative Rock", "Metal", "Pop", "J-Pop", "K-Pop", "Electronic",
    "EDM", "House", "Trap Music", "Drum and Bass", "Breakcore", "Hyperpop",
    "Chiptune", "Jazz", "Hip Hop", "Ballad", "Ambient Music",
    "Cute", "Dark Mood", "Sad Mood", "Calm Mood", "Funny", "Creepy", "Cool",
    "Love Theme", "Death Theme", "Blood Theme", "Supernatural Theme",
    "Religion Theme", "Animal Theme", "Nature Theme", "Seasonal Theme",
    "2D Animation", "3D Animation", "Editor PV", "Official Art PV",
    "Live Action PV", "Music Visualization", "Pixel Art", "Kinetic Typography",
    "AI-Generated Art",
    "Color Theme",
    "Cross-Lingual Synthesis", "Human Vocals", "Robotic Vocals", "Harsh Vocals",
    "Speech Vocals", "Vocal Range", "Rapping", "Choir Vocals", "A Cappella",
    "Tuning Quality", "Voice Genderswap",
    "Beta Voicebank", "Unofficial Voicebank", "Imported Voicebank",
    "Voicebank Release", "Voicebank Demo", "Derived Voicebank",
    "Unconfirmed Vocalist",
    "Derivative Work", "Cover", "Self-Cover", "Fan Work", "Parody", "Remix",
    "Changed Lyrics", "Changed Language", "Version Variant", "Debut Work",
    "Duet", "Group Ensemble",
    "Subtitled", "Multilingual", "Unsupported Language", "Instrumental",
    "Source Data Available", "Karaoke Available",
    "Piano", "Electric Guitar", "Acoustic Guitar", "Sampling",
    "Production Software",
    "Flashing Lights Warning", "Explicit Content", "Content Warning",
    "Anime Original Song", "Video Game Theme", "Franchise Reference",
    "Vocalist Character", "MMD Model",
    "Retro Style", "80s Style", "Japanese Traditional Style",
    "Experimental", "Meme",
)
