"""The canonical schema: columns, semantic types, tags and labels. All values here are fixed by the data model."""

#: Canonical column -> attribute, in order.
ATTRIBUTES = {
    "Record #": "record_no", "Label": "label", "ISRC": "isrc", "Date Submitted": "date_submitted", "UPC": "upc",
    "Album cat. No.": "album_cat_no", "Album Name": "album_name", "Track Name": "track_name", "Release Date": "release_date",
    "Singer": "singer", "Audio Duration (mm:sec)": "audio_duration", "Content Type": "content_type",
    "Vocal / Instrumental": "vocal_instrumental", "Language": "language", "Genre": "genre", "Lyricist": "lyricist",
    "Composer": "composer", "Territory Rights": "territory_rights", "God Name": "god_name",
    "Audio folder (path)": "audio_folder", "JPG folder (path)": "jpg_folder", "LRC File (path)": "lrc_file",
    "Lyrical Video (path)": "lyrical_video", "Go Live Date": "go_live_date", "Revenue Share": "revenue_share",
    "Revenue Split": "revenue_split", "Distributor": "distributor", "Territory Restriction": "territory_restriction",
    "Lead Artist": "lead_artist", "Agreement No.": "agreement_no",
}
COLUMNS = list(ATTRIBUTES)

#: Semantic type of each canonical column; any other column is text.
TYPES = {
    "Record #": "serial", "Label": "label", "ISRC": "isrc", "Date Submitted": "date", "UPC": "upc", "Album cat. No.": "code",
    "Album Name": "title", "Track Name": "title", "Release Date": "date", "Singer": "name",
    "Audio Duration (mm:sec)": "duration", "Content Type": "category", "Vocal / Instrumental": "vocal_instrumental",
    "Language": "language", "Genre": "category", "Lyricist": "name", "Composer": "name", "Territory Rights": "category",
    "God Name": "text", "Audio folder (path)": "path", "JPG folder (path)": "path", "LRC File (path)": "path",
    "Lyrical Video (path)": "path", "Go Live Date": "date", "Revenue Share": "text", "Revenue Split": "percent",
    "Distributor": "category", "Territory Restriction": "text", "Lead Artist": "name", "Agreement No.": "code",
}
REQUIRED = ("ISRC", "Track Name")
COSMETIC = ("text", "category", "language", "serial", "path")

#: The note that a fix of each type leaves.
FIX_TAGS = {
    "isrc": "normalized_isrc", "upc": "normalized_upc", "date": "reformatted_date", "duration": "normalized_duration",
    "vocal_instrumental": "standardized_category", "language": "normalized_language", "percent": "normalized_percent",
    "code": "normalized_code", "path": "normalized_path", "text": "trimmed", "name": "titlecased", "title": "titlecased",
    "category": "trimmed", "serial": "trimmed", "label": "standardized_category",
}

#: Tokens that stand for "no value".
PLACEHOLDERS = (
    "n/a", "na", "n.a.", "n.a", "n a", "#n/a", "#na", "null", "none", "nil", "nan", "tbd", "tba", "unknown", "unspecified",
    "not available", "not applicable", "xx", "xxx", "xxxx", "--", "---",
)

#: Language codes, and words for vocal or instrumental.
LANGUAGES = {
    "hin": "Hindi", "tam": "Tamil", "tel": "Telugu", "kan": "Kannada", "mal": "Malayalam", "mar": "Marathi", "ben": "Bengali",
    "guj": "Gujarati", "pun": "Punjabi", "pan": "Punjabi", "eng": "English", "san": "Sanskrit", "ori": "Odia", "ory": "Odia",
    "urd": "Urdu", "asm": "Assamese",
}
VOCALS = {
    "vocal": "Vocal", "vocals": "Vocal", "v": "Vocal",
    "instrumental": "Instrumental", "instru": "Instrumental", "inst": "Instrumental",
}

#: Fields compared between rows of one ISRC; identity leaves out the serial number and the owners.
DEDUP_FIELDS = ("ISRC", "UPC", "Label", "Album Name", "Track Name", "Singer", "Composer", "Lyricist", "Publisher", "Music Producer", "Language")
OWNERSHIP = ("Label", "Publisher", "Distributor")
IDENTITY = tuple(c for c in COLUMNS if c not in ("Record #", *OWNERSHIP))
CREDITS = ("Singer", "Composer", "Lyricist")
#: Columns that the short export leaves out; the long one has all.
MEDIA_PATHS = ("JPG folder (path)", "LRC File (path)", "Lyrical Video (path)")
PRESETS = {"PDL": [c for c in COLUMNS if c not in MEDIA_PATHS], "SVF": COLUMNS}
SEPARATOR = " | "
FIRST_YEAR, LONGEST_SECONDS = 1950, 36_000

#: Lowest score of each grade.
GRADES = ((97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (60, "D"))
