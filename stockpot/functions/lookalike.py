"""Letters of other scripts that look like Latin ones."""

#: Cyrillic and Greek letters and the Latin letters they look like (fixed values).
CYRILLIC = "АВЕЅІЇЈКМНОРСТУХҮԌԚԜӀЁ" + "аеѕіїјорсухүһԁԛԝӏѵё"
CYRILLIC_LATIN = "ABESIÏJKMHOPCTYXYGQWIË" + "aesiïjopcyxyhdqwlvë"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹ" + "αγικνορσυχϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXJC" + "ayikvopouxcj"
LOOK = CYRILLIC + GREEK
LATIN = CYRILLIC_LATIN + GREEK_LATIN
