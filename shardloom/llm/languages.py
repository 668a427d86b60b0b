"""Common function words by language, as fixed values shared by the text operators."""

from __future__ import annotations

#: Common function words by language.
BY_LANGUAGE = {
    "en": "the of and to a an in is was that it for on with as by at from are were be this which not or have had they their his her its but we you i he she them then so if when there",
    "de": "der die das und ist ein eine im in den von zu mit auf nicht sich des dem es wird während daneben steht aus auch noch wurde liegt ohne",
    "es": "el la los las de que y en un una por con no para su al del se es lo como más donde sin fue está",
    "fr": "le la les de des du et un une dans est que qui pour pas sur au aux par ne avec près plus sans sont était",
    "it": "il lo la gli le di che e un una in per non con del della sono è al nel più senza",
    "pt": "o os as de que e um uma em por com não para do da no na se é mais sem foi",
    "nl": "de het een en van in is op te dat die voor met niet aan zijn er ook zonder werd",
}

#: The languages of every listed word.
FUNCTION_WORDS: dict[str, tuple[str, ...]] = {}
for _lang, _words in BY_LANGUAGE.items():
    for _word in dict.fromkeys(_words.split()):
        FUNCTION_WORDS[_word] = (*FUNCTION_WORDS.get(_word, ()), _lang)
