"""Other names of the canonical columns."""

#: What sheets call each canonical column besides its own name.
SYNONYMS = {
    "Record #": ["record number", "record no", "rec no", "sr no", "serial no", "sl no", "s no", "srno", "record", "sno", "row number"],
    "Label": ["record label", "label name"],
    "ISRC": ["isrc code", "isrc no", "isrc number"],
    "Date Submitted": ["submitted date", "submission date", "submitted on", "date of submission", "submit date"],
    "UPC": ["upc code", "ean", "barcode", "upc ean", "ean code"],
    "Album cat. No.": ["album catalog number", "album cat no", "catalog no", "catalogue no", "cat no", "album catalogue number", "album catalog no", "catalog number"],
    "Album Name": ["album", "album title"],
    "Track Name": ["track", "song name", "song title", "title", "song", "track title"],
    "Release Date": ["release dt", "date of release", "released on", "release"],
    "Singer": ["artist", "artist name", "vocalist", "performer", "singer name", "singers", "artists", "vocal artist"],
    "Audio Duration (mm:sec)": ["duration", "audio duration", "track duration", "length", "audio length", "runtime", "song duration"],
    "Content Type": ["content"],
    "Vocal / Instrumental": ["vocal instrumental", "vocal or instrumental", "vocals instrumental"],
    "Language": ["lang"],
    "Genre": ["genres", "music genre"],
    "Lyricist": ["lyric writer", "lyrics writer", "lyrics", "lyric", "written by", "penned by", "writer", "lyricists", "lyrics by", "lyric by"],
    "Composer": ["music composer", "composed by", "music director", "composers", "music", "composition"],
    "Territory Rights": ["territory", "rights territory", "territory right", "rights"],
    "God Name": ["deity", "deity name", "god"],
    "Audio folder (path)": ["audio folder", "audio path", "audio file path", "audio folder path"],
    "JPG folder (path)": ["jpg folder", "image folder", "artwork folder", "jpg path", "image path", "jpg folder path", "artwork path", "cover folder"],
    "LRC File (path)": ["lrc file", "lrc path", "lyric file", "lrc"],
    "Lyrical Video (path)": ["lyrical video", "lyric video", "video path", "lyrical video path"],
    "Go Live Date": ["golive date", "live date", "go live", "golive", "go live dt"],
    "Revenue Share": ["rev share", "revenue sharing", "royalty share"],
    "Revenue Split": ["rev split", "revenue splitting", "royalty split"],
    "Distributor": ["distribution", "distributed by"],
    "Territory Restriction": ["territory restrictions", "restricted territory", "territory restrict"],
    "Lead Artist": ["primary artist", "main artist", "featured artist", "lead singer", "lead", "feat artist"],
    "Agreement No.": ["agreement number", "contract no", "contract number", "agreement", "agreement no"],
}
