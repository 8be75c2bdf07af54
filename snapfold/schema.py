"""Tables of a library, their identities, references and constraints, as data."""

from __future__ import annotations

#: Names of the format. Column types of each table; every table also has owner_id, seq (order of its snapshot) and row_ord.
TABLES = {
    "Location": "LocationId long, BookNumber long, ChapterNumber long, DocumentId long, Track long, IssueTagNumber long, KeySymbol string, MepsLanguage long, Type long, Title string, Specialty string, Edition string",
    "UserMark": "UserMarkId long, ColorIndex long, LocationId long, StyleIndex long, UserMarkGuid string, Version long",
    "BlockRange": "BlockRangeId long, BlockType long, Identifier long, StartToken long, EndToken long, UserMarkId long",
    "Note": "NoteId long, Guid string, UserMarkId long, LocationId long, Title string, Content string, LastModified string, Created string, BlockType long, BlockIdentifier long",
    "Bookmark": "BookmarkId long, LocationId long, PublicationLocationId long, Slot long, Title string, Snippet string, BlockType long, BlockIdentifier long",
    "InputField": "LocationId long, TextTag string, Value string",
    "Tag": "TagId long, Type long, Name string",
    "TagMap": "TagMapId long, PlaylistItemId long, LocationId long, NoteId long, TagId long, Position long",
    "IndependentMedia": "IndependentMediaId long, OriginalFilename string, FilePath string, MimeType string, Hash string",
    "PlaylistItem": "PlaylistItemId long, Label string, StartTrimOffsetTicks long, EndTrimOffsetTicks long, Accuracy long, EndAction long, ThumbnailFilePath string",
    "PlaylistItemAccuracy": "PlaylistItemAccuracyId long, Description string",
    "PlaylistItemIndependentMediaMap": "PlaylistItemId long, IndependentMediaId long, DurationTicks long",
    "PlaylistItemLocationMap": "PlaylistItemId long, LocationId long, MajorMultimediaType long, BaseDurationTicks long",
    "PlaylistItemMarker": "PlaylistItemMarkerId long, PlaylistItemId long, Label string, StartTimeTicks long, DurationTicks long, EndTransitionDurationTicks long",
    "PlaylistItemMarkerBibleVerseMap": "PlaylistItemMarkerId long, VerseId long",
    "PlaylistItemMarkerParagraphMap": "PlaylistItemMarkerId long, MepsDocumentId long, ParagraphIndex long, MarkerIndexWithinParagraph long",
    "LastModified": "LastModified string",
    "grdb_migrations": "identifier string",
}

KEY = "owner_id long, seq int, row_ord long"


def has_id(table: str) -> bool:
    """Whether a row has an integer id of its own in the first column; the others order their rows otherwise."""
    name, kind = TABLES[table].split(", ")[0].split()
    return kind == "long" and name == f"{table}Id"


#: Columns that make two places the same one.
LOCATION_IDENTITY = ("BookNumber", "ChapterNumber", "DocumentId", "Track", "IssueTagNumber", "KeySymbol", "MepsLanguage", "Type", "Specialty", "Edition")

#: Fixed values: (child, column, parent, column)
REFERENCES = (
    ("UserMark", "LocationId", "Location", "LocationId"),
    ("BlockRange", "UserMarkId", "UserMark", "UserMarkId"),
    ("Note", "UserMarkId", "UserMark", "UserMarkId"),
    ("Note", "LocationId", "Location", "LocationId"),
    ("Bookmark", "LocationId", "Location", "LocationId"),
    ("Bookmark", "PublicationLocationId", "Location", "LocationId"),
    ("InputField", "LocationId", "Location", "LocationId"),
    ("TagMap", "PlaylistItemId", "PlaylistItem", "PlaylistItemId"),
    ("TagMap", "LocationId", "Location", "LocationId"),
    ("TagMap", "NoteId", "Note", "NoteId"),
    ("TagMap", "TagId", "Tag", "TagId"),
    ("PlaylistItem", "Accuracy", "PlaylistItemAccuracy", "PlaylistItemAccuracyId"),
    ("PlaylistItem", "ThumbnailFilePath", "IndependentMedia", "FilePath"),
    ("PlaylistItemIndependentMediaMap", "PlaylistItemId", "PlaylistItem", "PlaylistItemId"),
    ("PlaylistItemIndependentMediaMap", "IndependentMediaId", "IndependentMedia", "IndependentMediaId"),
    ("PlaylistItemLocationMap", "PlaylistItemId", "PlaylistItem", "PlaylistItemId"),
    ("PlaylistItemLocationMap", "LocationId", "Location", "LocationId"),
    ("PlaylistItemMarker", "PlaylistItemId", "PlaylistItem", "PlaylistItemId"),
    ("PlaylistItemMarkerBibleVerseMap", "PlaylistItemMarkerId", "PlaylistItemMarker", "PlaylistItemMarkerId"),
    ("PlaylistItemMarkerParagraphMap", "PlaylistItemMarkerId", "PlaylistItemMarker", "PlaylistItemMarkerId"),
)
