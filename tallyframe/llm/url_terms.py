"""The default URL vocabulary, as data: terms that reject alone, and soft terms with weights."""

#: One of these rejects a URL.
STRICT_TERMS = tuple(
    """
    porn porno porns pornhub pornstar pornstars xxx xvideos xhamster xnxx redtube youporn brazzers bangbros hentai milf milfs camgirl camgirls camwhore
    cumshot cumshots blowjob blowjobs handjob deepthroat gangbang bukkake creampie upskirt upskirts bdsm shemale shemales escortservice sexcam sexcams sexchat
    sextape sexvideo sexvideos casino casinos onlinecasino viagra cialis levitra tramadol xanax warez keygen keygens crackz serialz nulled malware phishing
    """.split()
)

#: Soft terms by weight; different ones add up. Words that honest addresses hold too weigh least.
SOFT_TERMS = {
    term: weight
    for weight, terms in {
        6: """
        sex sexy adult nude nudes naked erotic erotica escort escorts fetish fetishes lingerie webcam webcams striptease stripper strippers playboy lesbians
        betting gambling poker roulette blackjack sportsbook bookmaker slots jackpot torrent torrents cracked pirated piratebay steroids
        """,
        4: """
        dating singles hookup hookups affair bet bets wager bingo lottery lotto loan loans payday refinance creditrepair pills pill pharmacy pharmacies
        painkiller vicodin oxycodone crack cracks serial patch hack hacks hacked cheat cheats replica replicas knockoff counterfeit weightloss dietpills forex
        """,
        2: """
        free download downloads bonus bonuses win winner prize prizes cheap cheapest discount deal deals earn income rich money cash hot live girls teen teens
        babes click clicks survey surveys coupon coupons
        """,
    }.items()
    for term in terms.split()
}
