"""A small labelled table of urls for the classifier of operator 5: invented sites by family, written by hand.

Unwanted families are named, so that a test can leave one out and ask for it.  No row is taken from a table that is judged.
"""

from __future__ import annotations

import random

#: Family -> sites, as host names without their zone; each is unwanted.
UNWANTED = {
    "betting": "bestbets24 betting-tips sportsbet-club betnow oddsbet livebets bet-kings superbet bet-arena onlinebets freebet-bonus footybets horse-betting".split(),
    "casino": "royal-casino casino-nights winbig slotmania lucky-slots mega-slots pokerroom poker-kings roulette-live jackpot-city jackpots-daily vegas-casino spin-win casino-bonus".split(),
    "pharmacy": "pills-direct rx-pharmacy cheapmeds viagra-shop discount-pills pharmacy-online diet-pills buy-cialis meds4less cheap-viagra pill-store noscript-pharma".split(),
    "adult": "xxx-videos adult-dating porn-tube sexcams adult-chat hot-xxx nude-gallery adultmatch sexy-singles xxx-movies adult-toys escort-finder".split(),
    "spam": "spamhub spam-mailer link-farm linkfarm seo-farm backlink-farm bulk-mail spamlists mass-spam content-farm doorway-spam clickfarm".split(),
    "adverts": "adserver ads-network adtrack trackpixel ad-tracker popunder popup-ads banner-ads clicktrack trackads retarget-ads ad-exchange".split(),
    "cheap": "cheap-loans payday-cash cheapwatches replica-bags cheap-rolex fast-loans quick-cash easy-credit cheap-seo cheap-followers earn-money-fast get-rich-now".split(),
    "theft": "warez-world crack-keygen serial-keys free-cracks torrent-hub keygen-zone phish-login verify-account-now free-gift-card prize-winner claim-prize malware-drop".split(),
}
ORDINARY = (
    "city-library state-university garden-club science-museum daily-news weather-center travel-notes history-archive open-docs music-school local-sports recipes-at-home health-info book-review art-gallery chess-club "
    "bird-watch bike-routes river-trust parish-church film-festival farm-shop dairy-farm tracker-dogs adder-snakes addison-press cheapside-history better-homes alphabet-school beta-release bettys-kitchen diabetes-support "
    "winter-garden windmill winery spinning-wool slotted-spoon poker-plant adults-learning essex-county sussex-walks middlesex-hospital pharmacology-journal pillow-talk spillway cashmere-knits loan-library credit-union "
    "keyboard-reviews crackers-bakery torrential-rain giftwrap prize-essays mathforum physics-notes python-docs linux-wiki map-archive old-photos census-data town-hall fire-brigade school-board choir-book poetry-hall "
    "mountain-rescue harbour-master railway-society stamp-collectors astronomy-club geology-field botany-index marine-lab language-course grammar-guide dictionary-online encyclopedia-mirror podcast-notes radio-archive "
    "parliament-records court-reports tax-office job-center housing-advice consumer-guide energy-saving recycling-center forest-watch animal-shelter hospital-visits dental-care nursing-college yoga-studio dance-theatre "
    "ceramics-workshop knitting-patterns quilt-museum woodwork-plans cooking-class tea-house coffee-roasters bread-oven cheese-makers wine-cellar fishing-reports sailing-club ski-school football-results cricket-scores "
    "news blog docs wiki library museum archive forum journal books shop mail static cdn www2 example site page home"
).split()
ZONES = ("com", "net", "org")
UNWANTED_PATHS = "/casino/bonus /poker/win /pills/order /viagra/cheap /xxx/1 /adult/join /bets/today /slots/free /warez/list /torrent/get /spam/unsubscribe /ads/click /track?id=1 /loans/payday".split()
ORDINARY_PATHS = "/ /index.html /about /en/12 /de/7 /fr/99 /es/3 /a/1 /p/20 /2020/05/article.html /docs/guide /wiki/Main_Page /post/hello-world /search?q=x /img/logo.png /category/history?page=2 /reports/annual.pdf#top".split()


def _names(n: int = 240, seed: int = 11) -> list[str]:
    """Invented ordinary names, as most sites have names that no word list holds: two to four syllables of any letters."""
    rnd = random.Random(seed)
    syllable = lambda: rnd.choice("bcdfghjklmnprstvwz") + rnd.choice(["", "h", "r", "l"]) + rnd.choice("aeiou") + rnd.choice(["", "", "n", "r", "s", "t"])
    consonants = lambda: "".join(rnd.choice("bcdfghklmnprstw") for _ in range(rnd.randrange(3, 7)))
    return [consonants() if k % 4 == 0 else "".join(syllable() for _ in range(rnd.randrange(2, 5))) for k in range(n)]


def labelled_urls(without: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(url, 1 if unwanted) of every site under several zones and paths; `without` leaves families out."""
    rows: list[tuple[str, int]] = [("", 0)]
    sites = [(s, 1) for family, names in UNWANTED.items() if family not in without for s in names] + [(s, 0) for s in (*ORDINARY, *_names())]
    for k, (site, label) in enumerate(sites):
        for n in range(3):
            host = f"{('', 'www.', 'm.')[(k + n) % 3]}{site}{('', '.example')[(k + n) % 2]}.{ZONES[(k + n) % len(ZONES)]}"
            rows.append((f"http{'s' * (n % 2)}://{host}{ORDINARY_PATHS[(5 * k + 7 * n) % len(ORDINARY_PATHS)]}", label))
    if not without:
        rows += [(f"https://{ORDINARY[(3 * k) % len(ORDINARY)]}.example.org{path}", 1) for k, path in enumerate(UNWANTED_PATHS)]
    return rows
