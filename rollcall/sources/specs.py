"""What the three exports look like, and the rules' fixed values."""

from __future__ import annotations

from dataclasses import dataclass

# Spellings of cities, in lower case, and the one that is kept.
CITY_ALIASES = {
    "bangalore": "Bengaluru",
    "bengaluru": "Bengaluru",
    "gurgaon": "Gurugram",
    "gurugram": "Gurugram",
    "noida": "Noida",
    "pune": "Pune",
    "delhi": "Delhi",
    "new delhi": "New Delhi",
    "delhi ncr": "Delhi NCR",
}

# Skills in lower case, and how they are shown.
SKILL_NAMES = {
    "docker": "Docker",
    "fastapi": "FastAPI",
    "javascript": "JavaScript",
    "langchain": "LangChain",
    "mongodb": "MongoDB",
    "mysql": "MySQL",
    "n8n": "n8n",
    "pandas": "Pandas",
    "python": "Python",
    "react": "React",
    "rest apis": "REST APIs",
    "selenium": "Selenium",
    "sql": "SQL",
    "web scraping": "Web Scraping",
    "zapier": "Zapier",
}

# Accepted media types and the extension given to each.
MEDIA_EXTENSIONS = {
    "audio/webm": ".webm",
    "audio/ogg": ".ogg",
    "audio/mpeg": ".mp3",
    "audio/mp3": ".mp3",
    "audio/mp4": ".m4a",
    "audio/x-m4a": ".m4a",
    "audio/aac": ".aac",
    "audio/wav": ".wav",
    "audio/x-wav": ".wav",
    "audio/wave": ".wav",
    "audio/flac": ".flac",
    "audio/x-flac": ".flac",
}
# Words for states and flags, limits of an upload, the lakh, and the bounds of what is plausible, clean, fair and silent.
STATUSES = ("active", "inactive", "paused")
YES, NO = ("y", "yes"), ("n", "no")
LARGEST_UPLOAD = 25 * 1024 * 1024
LONGEST_NAME = 200
RUPEES_A_LAKH = 100_000
PLAUSIBLE_CTC = (100_000, 10_000_000)
CLEAN_DB, FAIR_DB, SILENCE_DB = 40.0, 15.0, -120.0


@dataclass(frozen=True)
class ExportSpec:
    """One export: its header, the columns' names here, and the key column with its shape."""

    name: str
    header: tuple[str, ...]
    columns: tuple[str, ...]
    key: int
    key_pattern: str

    @property
    def key_header(self) -> str:
        return self.header[self.key]


# The headers of the exports, and the shapes of their keys.
AT_SIGN, A_DIGIT = "@", r"\p{Nd}"
BRIDGE = ExportSpec(
    "bridge",
    ("Full Name", "Email", "Phone", "City", "Experience (Years)", "Current CTC", "Applied Date", "Skills"),
    ("full_name", "email", "phone", "city", "experience", "ctc", "applied_date", "skills"),
    1,
    AT_SIGN,
)
GIGS = ExportSpec("gigs", ("email_id", "worker_name", "rate", "location", "status", "skill_tags"), ("email", "full_name", "rate", "city", "status", "skills"), 0, AT_SIGN)
CONTACTS = ExportSpec("contacts", ("Name", "Phone Number", "City", "Verified", "Projects Completed"), ("full_name", "phone", "city", "verified", "projects"), 1, A_DIGIT)
