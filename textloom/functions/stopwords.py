"""Short stopword lists of our own."""

from __future__ import annotations

_LISTS = {
    "english": "a about above after again all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours",
    "german": "aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dein dem den der des die dir doch du durch ein eine einem einen einer eines er es euch für gegen hat hatte haben hier ich ihm ihn ihr im in ist ja kann kein keine mein mich mir mit nach nicht noch nun nur ob oder ohne sehr sein seine sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur",
    "french": "à au aux avec ce ces cette d dans de des du elle elles en est et eu il ils j je l la le les leur lui m ma mais me mes moi mon n ne nos notre nous on ont ou par pas pour qu que qui s sa se ses son sur ta te tes toi ton tu un une vos votre vous y",
    "spanish": "a al algo como con de del desde donde el ella ellos en entre era es esta este estos fue ha hay la las le les lo los me mi más muy ni no nos o para pero por porque que se sin sobre son su sus también te tu un una uno y ya yo",
    "dutch": "aan al als bij dan dat de der deze die dit door een en er had heb hebben heeft het hij hoe hun ik in is je kan maar me men met mij na naar niet nog nu of om omdat onder ons ook op over te tot u uit van veel voor was wat we werd wie wij zal ze zich zij zijn zo zou",
}


def stopwords(language: str) -> list[str]:
    """The stopwords of a language."""
    if language not in _LISTS:
        raise ValueError(f"no stopwords for {language!r}; there are lists for {sorted(_LISTS)}")
    return _LISTS[language].split()


def languages() -> list[str]:
    return sorted(_LISTS)
