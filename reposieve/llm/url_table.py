"""Small labelled table of URLs: fixed values that the URL filter is trained on."""

BLOCKED = """
casino-royal.example.net/en/1 casino-win.example.org/play win-casino.example.net/slots online-casino.example.net/bonus casino.example.org/
grand-casino.example.net/de/12.html best-casino-bonus.example.org/win poker-stars.example.net/table poker-room.example.org/en/4 free-poker.example.net/
slots-jackpot.example.net/spin mega-slots.example.org/win jackpot-city.example.net/en/77 roulette-live.example.org/play lotto-win.example.net/ticket
free-bets.example.org/en/9 sport-bets.example.net/odds bets-now.example.net/de/3 betting-tips.example.org/today bet-win.example.net/en/5 live-betting.example.net/
cheap-pills.example.org/buy pills-online.example.net/en/2 diet-pills.example.net/offer discount-pharmacy.example.org/pills viagra-shop.example.net/buy
cialis-cheap.example.org/order pharma-discount.example.net/meds cheap-meds.example.org/en/8 weight-loss-pills.example.net/now steroids-shop.example.net/
adult-x.example.org/en/6 adult-video.example.net/watch adult-chat.example.org/live xxx-tube.example.net/video porn-hub.example.org/watch porn-free.example.net/
sex-cams.example.net/live sexy-girls.example.org/pics escort-service.example.net/city hot-dating.example.org/adult nude-pics.example.net/gallery webcam-xxx.example.org/
spam-farm.example.net/en/3 spam-links.example.org/page link-farm.example.net/seo seo-spam.example.org/buy-links buy-backlinks.example.net/cheap click-farm.example.org/
ads-track.example.org/pixel ads-server.example.net/banner ad-track.example.net/click track-ads.example.org/en/1 adserver.example.net/popup click-track.example.org/ad
popunder-ads.example.net/show banner-exchange.example.org/ads pixel-tracker.example.net/t.gif affiliate-ads.example.org/redirect doubleads.example.net/serve
free-warez.example.net/crack keygen-crack.example.org/download serial-crack.example.net/key torrent-crack.example.org/get malware-host.example.net/exe
phish-login.example.org/account bank-phish.example.net/verify payday-loans.example.org/apply fast-loans-cheap.example.net/cash free-money-now.example.org/win
crypto-doubler.example.net/win get-rich-quick.example.org/now replica-watches.example.net/cheap fake-bags.example.org/buy-cheap miracle-cure.example.net/pills
www.spam-site.example.org/de/12 www.spam-farm.example.org/en/7.html blog.spam-net.example.net/fr/3.html m.spam.example.org/es/81/ www.casino-bonus.example.org/de/4
m.casino.example.net/fr/12 blog.casino-play.example.org/es/6 www.poker-win.example.net/es/9 m.bets.example.org/de/33 www.free-bets.example.net/fr/90 blog.bets-win.example.org/es/2
www.pills.example.org/de/5 m.cheap-meds.example.net/fr/17 blog.diet-pills.example.org/es/44 www.adult-pics.example.net/de/8 m.adult-x.example.org/fr/61 blog.xxx.example.net/es/3
www.ads-click.example.org/de/70 m.ads-pixel.example.net/fr/5 blog.track-pixel.example.org/es/19 www.porn.example.org/de/1.html m.warez.example.net/fr/2 blog.crack.example.org/es/7
""".split()

ALLOWED = """
www.example.net/ www.example.org/en/1 blog.example.net/en/12 m.example.org/de/4.html news.example.net/world/2020/05/flood docs.example.org/guide/install
wiki.example.org/page/river library.example.net/catalogue/77 museum.example.org/en/visit university.example.net/department/physics school.example.org/plan
garden.example.net/roses/12 kitchen.example.org/recipes/soup weather.example.net/de/berlin maps.example.org/en/route music.example.net/concert/9
books.example.org/en/author/4 travel.example.net/fr/paris science.example.org/article/33 history.example.net/en/rome health.example.org/advice/sleep
journal.example.net/volume/3/issue/2 forum.example.org/thread/991 shop.example.net/product/51 hotel.example.org/rooms theatre.example.net/programme
bridge.example.org/en/81 valley-post.example.net/en/3 mountain.example.org/de/66.html forest.example.net/en/5 harbour.example.org/de/9 island.example.net/en/71
thander.example.net/en/853 inghen.example.org/de/17 ouredes.example.net/en/48.html thereon.example.org/en/25 ontisher.example.net/de/216 erandin.example.org/en/302
www.nderes.example.net/en/923 blog.thaton.example.org/en/78 m.restion.example.net/de/231 blog.inther.example.org/en/667.html www.hereand.example.net/en/118
m.edthing.example.org/de/545 estend.example.net/en/770 orthand.example.org/en/606 blog.tionare.example.net/de/174 www.whened.example.org/en/297
stander.example.net/en/20 blething.example.org/en/588 m.shandon.example.net/de/735 houred.example.org/en/510 thistle.example.net/en/414 northern.example.org/en/618
lichter.example.net/de/44 schule.example.org/de/stundenplan verein.example.net/de/termine zeitung.example.org/de/lokales bahnhof.example.net/de/fahrplan
wetter.example.org/de/heute rezepte.example.net/de/suppe garten.example.org/de/rosen buecher.example.net/de/neu reise.example.org/de/meer
maison.example.net/en/plan cuisine.example.org/en/soupe jardin.example.net/en/fleurs musique.example.org/en/concert voyage.example.net/en/mer
escuela.example.org/en/plan cocina.example.net/en/sopa jardin.example.org/en/flores libros.example.net/en/autor viaje.example.org/en/mar
static.example.net/css/site.css img.example.org/photo/12.jpg api.example.net/v1/items status.example.org/ help.example.net/faq jobs.example.org/open
community.example.net/en/meeting church.example.org/en/choir council.example.net/en/budget court.example.org/en/decision parliament.example.net/en/debate
football.example.org/en/season chess.example.net/en/openings cycling.example.org/en/route sailing.example.net/en/weather running.example.org/en/plan
physics.example.net/en/lecture/4 algebra.example.org/en/proof chemistry.example.net/de/labor biology.example.org/en/cells astronomy.example.net/en/moon
python.example.org/en/tutorial spark.example.net/en/guide database.example.org/en/index compiler.example.net/en/lexer network.example.org/en/packets
anderth.example.net/es/31 www.enthand.example.org/es/4/ m.ereath.example.net/es/77 blog.inston.example.org/fr/5 ouentha.example.net/fr/68.html www.leraine.example.org/fr/9
rionthe.example.org/es/12 m.stonger.example.org/fr/40/ blog.hearthe.example.net/es/8 www.andore.example.net/fr/3 thation.example.org/de/51/ m.endering.example.net/es/6.html
track-and-field.example.net/en/results advice.example.org/en/letters adventure.example.net/en/hike winter.example.org/en/snow window.example.net/en/glass
betony.example.org/en/plant better-roads.example.net/en/works spammer-free-mail.example.org/en/help cheapside.example.net/en/street freedom.example.org/en/press
""".split()
