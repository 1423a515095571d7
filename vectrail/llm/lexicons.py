"""Vocabularies of the toxicity and URL operators, by language.

Compiled by hand from everyday dictionary entries marked as insulting or vulgar
and from the words that common blocking lists agree on; weights are from 0.5
(mild, often innocent) to 5.  They are defaults: every operator takes its own.
"""

from __future__ import annotations

_INSULTS: dict[str, str] = {
    "en": """
        idiot:2 moron:2 stupid:1 trash:1 scum:3 loser:2 pathetic:1.5 worthless:2 disgusting:1.5 clown:1 imbecile:2
        dumb:1 dumbass:3 jackass:3 asshole:4 arsehole:4 bastard:3 bitch:4 crap:1 cretin:2 creep:1.5 douchebag:4
        dipshit:4 fool:1 fuck:4 fucking:4 fucker:4 motherfucker:5 garbage:1 hateful:1 jerk:1.5 kill_yourself:5
        lunatic:1.5 lowlife:3 parasite:2 retard:4 retarded:4 shit:3 bullshit:3 shithead:4 shut_up:1 slut:4 vermin:3
        whore:4 dimwit:2 nitwit:2 halfwit:2 degenerate:2 filthy:1 go_to_hell:3 piece_of_shit:5 scumbag:3 subhuman:4
        wanker:4 tosser:3 twat:4 cunt:5 dickhead:4 prick:3 pillock:2 bollocks:2 dolt:1.5 numbskull:2 dunce:1.5
        airhead:1.5 sleazebag:3 dirtbag:3 shitty:2 screw_you:3 drop_dead:3 nobody_likes_you:3 go_die:5""",
    "de": """
        idiot:2 trottel:2 dummkopf:2 vollidiot:3 depp:2 arschloch:4 wichser:4 hurensohn:5 missgeburt:5 drecksau:4
        schlampe:4 hure:4 fotze:5 scheiße:3 scheisse:3 abschaum:3 versager:2 schwachkopf:3 arschgeige:3 penner:2
        spast:4 halt_die_fresse:4 halts_maul:3 fick_dich:5 verpiss_dich:4 dreckskerl:3 mistkerl:3 vollpfosten:2
        hackfresse:3 blödmann:2 armleuchter:2 drecksack:3 pisser:3 untermensch:5""",
    "fr": """
        imbécile:2 crétin:2 connard:4 connasse:4 salope:5 salaud:4 enculé:5 pute:4 putain:2 merde:3 abruti:3 débile:2
        bouffon:2 ordure:3 racaille:3 bâtard:4 enfoiré:4 trou_du_cul:4 ta_gueule:3 ferme_ta_gueule:4 va_te_faire_foutre:5
        fils_de_pute:5 nique_ta_mère:5 tocard:2 minable:2 pauvre_type:2 sale_con:4 couillon:3 emmerdeur:3""",
    "es": """
        idiota:2 imbécil:2 estúpido:2 estúpida:2 gilipollas:4 cabrón:4 puta:4 hijo_de_puta:5 mierda:3 pendejo:4
        maricón:5 zorra:3 capullo:3 subnormal:4 cretino:2 tarado:3 escoria:3 basura_humana:4 vete_a_la_mierda:5
        malparido:5 culero:4 huevón:3 boludo:2 pelotudo:3 cállate_la_boca:2 inútil:1.5 payaso:1""",
    "it": """
        stronzo:4 stronza:4 coglione:4 cazzo:3 puttana:4 troia:4 figlio_di_puttana:5 bastardo:3 cretino:2 deficiente:3
        merda:3 vaffanculo:4 testa_di_cazzo:5 imbecille:2 scemo:2 rincoglionito:4 feccia:3""",
    "pt": """
        otário:3 babaca:3 filho_da_puta:5 caralho:3 merda:3 vadia:4 puta:4 cuzão:4 arrombado:4 desgraçado:3 burro:1
        imbecil:2 retardado:4 escroto:3 vai_se_foder:5 lixo_humano:4""",
    "nl": "klootzak:4 eikel:3 kutwijf:5 hoer:4 mongool:4 debiel:3 sukkel:2 lul:3 rotzak:3 tering:2 tyfus:2 stommeling:2 uitschot:3",
    "pl": "kurwa:3 debil:3 kretyn:2 skurwysyn:5 chuj:4 pierdol_się:5 dziwka:4 szmata:3 gnój:3 palant:2 śmieć:2 spierdalaj:4",
    "ru": """
        дурак:2 идиот:2 дебил:3 мудак:4 сука:4 блядь:4 шлюха:4 мразь:4 ублюдок:4 тварь:3 урод:2 придурок:3 говно:3
        дерьмо:3 козёл:2 сволочь:3 кретин:2 заткнись:2 пошёл_на_хуй:5 иди_нахуй:5 хуй:4 пидор:5 сдохни:5""",
    "tr": "aptal:2 salak:2 gerizekalı:3 orospu:5 piç:4 şerefsiz:3 siktir:4 göt:3 it_herif:3",
}
#: Phrases within which a term says nothing about anybody.
EXCEPTIONS: tuple[str, ...] = (
    "trash can", "trash cans", "trash bin", "clown fish", "clown car", "circus clown", "garbage collection",
    "garbage collector", "garbage can", "scum line", "pond scum", "class clown", "fool proof", "april fool",
    "sore loser", "winner and loser", "parasite drag", "host parasite", "jerk chicken", "no fool", "degenerate case",
    "shut up shop", "soap scum", "prick test", "skin prick", "creep rate", "idiot proof", "idiots guide",
)

_STRICT = """
    porn porno pornhub pornstar xxx xxxvideo xvideos xhamster xnxx redtube youporn youjizz hentai rule34 milf gilf camgirl
    camgirls camwhore livejasmin chaturbate onlyfans_leak live_sex sex_cam sexcam webcam_sex escorts escort_girls
    bestiality zoophilia gangbang cumshot creampie deepthroat blowjob handjob bukkake upskirt voyeur_cam incest_video
    warez keygen serialz crackz nulled phishing carding cvv_shop fullz buy_viagra buy_cialis nsfw
    pornographie pornofilm sexfilme pornos sexshop_live putas_gratis porno_gratis video_porno videos_porno film_porno
    порно порнуха секс_видео проститутки шлюхи эротика_видео πορνο エロ動画 アダルト動画 無修正 成人视频 色情 黄色网站 裸聊"""
_SOFT = """
    sex:2 sexy:1 adult:1 nude:2 nudes:2 naked:1 erotic:2 erotica:2 erotik:2 érotique:2 erotico:2 sexo:2 sesso:2 секс:2
    эротика:2 casino:2 kasino:2 казино:2 赌场:2 カジノ:2 poker:1 покер:1 betting:1 bet365:2 slots:1 roulette:1 jackpot:1
    apuestas:1 wetten:0.5 bonus:0.5 viagra:2 виагра:2 cialis:2 levitra:2 pills:1 payday:1 loan:0.5 loans:0.5 kredit:0.5
    torrent:1 crack:1 cracked:1 serial:0.5 dating:0.5 singles:0.5 hookup:1.5 знакомства:0.5 hot:0.5 girls:0.5 teens:1 free:0.5
    cheap:0.5 replica:1 xx:1 fetish:2 bdsm:2 lingerie:1 download:0.5 hack:1 hacks:1 cheats:0.5 escort:1.5 cam:0.5 webcam:0.5"""


def _pairs(text: str) -> dict[str, float]:
    return {t.replace("_", " "): float(w or 1) for t, _, w in (x.partition(":") for x in text.split())}


#: Insults of all languages; of a word in several the largest weight.
LEXICON: dict[str, float] = {}
for _text in _INSULTS.values():
    for _term, _weight in _pairs(_text).items():
        LEXICON[_term] = max(_weight, LEXICON.get(_term, 0.0))
STRICT: dict[str, float] = _pairs(_STRICT)
SOFT: dict[str, float] = _pairs(_SOFT)
