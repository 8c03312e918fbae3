"""Extension rulesets: which category a file extension belongs to."""

from __future__ import annotations

import re
from dataclasses import dataclass

OTHER = "other"

# The nine categories and the default extensions of eight of them. An extension listed
# twice belongs to the later category.
CATEGORY_EXTENSIONS = {
    "audio": "mp3 flac wav m4a ape ogg aac dsf",
    "disk_images": "iso img bin dmg vhd vhdx qcow2",
    "documents": "pdf doc docx xls xlsx ppt pptx txt md rtf odt",
    "executables": "exe msi apk appimage",
    "pictures": "jpg jpeg png gif webp heic heif tif tiff svg raw dng psd",
    "videos": "mp4 mkv avi mov ts m2ts webm rmvb",
    "web_and_code": "html css js ts vue json xml py go java c cpp",
    "archives": "zip 7z rar tar gz bz2 xz tar.gz tar.xz",
    "other": "",
}


@dataclass(frozen=True)
class Ruleset:
    version: int
    mapping: dict[str, str]

    def __post_init__(self) -> None:
        for extension, category in self.mapping.items():
            if len(extension) > 64 or not re.fullmatch(r"[a-z0-9+_-]+(\.[a-z0-9+_-]+)*", extension):
                raise ValueError(f"not a valid extension: {extension!r}")
            if category not in CATEGORY_EXTENSIONS:
                raise ValueError(f"not a category: {category!r}")

    def derive(self, changes: dict[str, str], removals: list[str] = ()) -> Ruleset:
        """The next version: removals first, then changes; naming an extension in both is an error."""
        both = set(changes) & set(removals)
        if both:
            raise ValueError(f"changed and removed: {sorted(both)}")
        missing = set(removals) - set(self.mapping)
        if missing:
            raise ValueError(f"not in the ruleset: {sorted(missing)}")
        kept = {k: v for k, v in self.mapping.items() if k not in set(removals)}
        return Ruleset(self.version + 1, kept | changes)


DEFAULT_RULESET = Ruleset(1, {e: c for c, es in CATEGORY_EXTENSIONS.items() for e in es.split()})
