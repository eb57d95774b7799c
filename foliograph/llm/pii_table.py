"""The labelled table that the tagger of personal data is trained on.

Texts are put together from short cues, typed slots and plain words of four languages: a slot's filler is a mention of its
kind, all else is none. Cues, words, names, places and number formats were chosen from general knowledge of letters,
forms and national formats; ``tests/llm`` holds that no name, street, town or host and no run of six words of the table
occurs in the test tables. More than half of all names and many other words are made of random syllables, so that the
tagger learns a mention's shape and surroundings instead of a list. ``HELD`` and ``HELD_CUES`` are never trained on.
"""

from __future__ import annotations

import random
import re

KINDS = ("name", "email", "phone", "id_number", "address")
Pieces = list[tuple[str, str | None]]


def _w(s: str) -> list[str]:
    return [x.replace("_", " ") for x in s.split()]


FIRST = _w(
    "James Robert Patricia Jennifer Michael Linda David Susan Daniel Laura Thomas Sarah Kevin Emma Oliver Sophie Lukas Hannah Jürgen Sabine Miguel Lucía Javier Isabel Pierre Camille Giulia Marco Piotr Katarzyna Lars Astrid Mehmet "
    "Priya Ahmed Fatima Kenji Grace Owen Chris Angela Brian Deborah Stephen Rachel Patrick Nicole Andrew Katherine Günther Ulrike Stefan Monika Álvaro Pilar Ramón Inés Jean-Luc Étienne Aisha Rajesh Wei Mei Tomasz Zofia Henrik Freja"
)
LAST = _w(
    "Smith Johnson Williams Brown Davis Wilson Anderson Taylor Clark Lewis Walker Hughes Edwards Morrison Fairweather Cartwright Smith-Jones Schmidt Weber Wagner Hoffmann Schwarzkopf Lindemann Fernández López Martínez Rossi Ferrari "
    "Dubois Moreau Kowalski Nowak Jensen Nilsson Johansson Yilmaz Tanaka Nguyen Patel Okafor MacDonald Petrov Virtanen Papadopoulos Van-Houten O'Brien de_la_Cruz van_Dijk Bergström Castellanos Chukwu Fitzgerald McCarthy Rasmussen"
)
FIRST_RU_M = _w("Александр Дмитрий Алексей Андрей Михаил Николай Владимир Евгений Константин Виктор Кирилл Артём Денис Валерий Вячеслав")
FIRST_RU_F = _w("Анна Елена Наталья Светлана Ирина Татьяна Екатерина Людмила Галина Юлия Валентина Оксана")
LAST_RU = _w("Петров Кузнецов Смирнов Попов Васильев Соколов Михайлов Новиков Морозов Волков Козлов Лебедев Никитин Захаров Голубев Фомин Калинин Воронин Щербаков Ильин Гусев Титов")
FATHER_RU = _w("Александров Дмитриев Николаев Михайлов Сергеев Петров Алексеев Андреев Викторов Иванов")
STREETS = _w("Church Station High Mill Park Victoria Green_Lane Elm Maple Cedar_Hill Washington Queen King Meadow Orchard Chestnut Market Franklin West_5th Sycamore")
WAYS = _w("Lane St. Street Rd Road Ave Avenue Terrace Court Close Way Boulevard Drive Place St Rd. Ave. Blvd Square Crescent")
TOWNS = _w("Leeds Bristol Norwich Denver Portland Springfield North_Haven Lake_Geneva Newcastle St._Albans Houston Little_Rock Exeter Bath_upon_Tay")
STREETS_DE = _w("Haupt Bahnhof Garten Schiller Goethe Berg Kirch Rosen Schul")
WAYS_DE = _w("straße str. gasse weg allee platz ring damm")
TOWNS_DE = _w("München Köln Bremen Leipzig Bad_Homburg Rostock Frankfurt_am_Main")
STREETS_ES = _w("Calle_Mayor Calle_de_Alcalá Paseo_de_Gracia Avenida_de_América Calle_San_Juan Plaza_de_España Camino_Real")
TOWNS_ES = _w("Madrid Valencia Sevilla Las_Palmas Bilbao Zaragoza")
STREETS_RU = _w("Ленина Садовая Пушкина Советская Лесная Гагарина Большая_Морская Школьная Зелёная Кирова")
TOWNS_RU = _w("Казань Мурманск Самара Нижний_Новгород Ростов-на-Дону Тверь Омск")
HOSTS = _w("gmail.com yahoo.com outlook.com mail.ru yandex.ru web.de correo.es firm.example shop.invalid lab.test")

#: Words before a slot and after it. A bar stands for a line break. Titles and posts are no part of a name.
BEFORE = {
    "name": {
        "en": "Mr|Mr.|Mrs|Mrs.|Ms|Ms.|Dr.|Dr|Prof.|Captain|Capt.|Officer|Chief Engineer|Second Engineer|Engineer|Chief Mate|Foreman|Mechanic|Fitter|Bosun|Dear Mr|Dear Mrs|Dear Ms|Dear|Hello|Hi|reported by|written by|checked by|approved by|seen by|signed by|taken by|sent by|according to|spoke to|spoke with|we told|they told|we asked|I asked|we met|thanks to|on behalf of|attention|Attn:|c/o|care of|From:|To:|Cc:|Name:|Owner:|Author:|Signed:|Witness:|statement of|issued to|handed to|given to|belongs to|recipient:|recipient|addressee|contact|Contact:|card:|file of|record of|crew member:|employee|visitor|passenger|for the attention of|Yours faithfully,\n|Sincerely,\n|Regards,\n|Best wishes,\n|Cheers,\n|Kind regards\n|Ship to:\n|Deliver to:\n",
        "de": "Herr|Herrn|Frau|Kapitän|Ingenieur|Meister|Sehr geehrter Herr|Sehr geehrte Frau|Liebe|Lieber|gezeichnet|unterschrieben von|geprüft von|laut|Ansprechpartner:|Ansprechpartner|Empfänger|Empfänger:|Name:|für|von|an|bei|Viele Grüße\n|Grüße,\n|Hochachtungsvoll\n",
        "es": "señor|el señor|la señora|Sr.|Sra.|don|doña|el capitán|el jefe|el técnico|el mecánico|ingeniero|Estimado señor|Estimada|firmado por|firmó|firma:|según|a nombre de|para|Nombre:|destinatario:|contacto:|Saludos,\n|Cordialmente,\n|Un saludo\n",
        "ru": "капитан|механик|старший механик|инженер|мастер|боцман|моторист|слесарь|господин|госпожа|Уважаемый|Уважаемая|принял|приняла|проверил|проверила|подписал|сообщил|заявку подал|работу выполнил|осмотр провёл|получатель|получатель:|ответственный:|контакт:|ФИО:|Имя:|сотрудник|сотрудника|данные:|карточка:|моряк|владелец|клиент|вручено|передано|выдано|отправлено|сообщили|от|для|С уважением,\n|С уважением\n|Подпись:",
    },
    "email": {
        "en": "write to|mail|e-mail|email|Email:|E-mail:|mail:|send it to|replies to|copy to|Cc:|contact|contact:|mailbox|the mailbox|address|reach us at|questions to|at",
        "de": "E-Mail:|E-Mail|an|Mail an|Fragen an|schreiben Sie an|Kopie an|unter",
        "es": "correo:|correo|escribir a|escriba a|envíe un correo a|copia a|preguntas a",
        "ru": "почта:|почта|эл. почта|пишите на|писать на|копия на|копию на|адрес почты|отправьте на|вопросы на|e-mail:",
    },
    "phone": {
        "en": "phone|phone:|Phone:|Tel.|Tel:|tel.|telephone|call|ring|dial|Mobile:|mobile|cell|fax|Fax:|by phone (|reach me on|call back on|new number is|number is|hotline|or call|on|at (|under",
        "de": "Tel.|Telefon|Telefon:|Tel.:|Mobil:|Handy|anrufen unter|unter|Fax|Rückruf unter",
        "es": "tel.|teléfono|Teléfono:|móvil|llame al|llamar al|o llame al|fax",
        "ru": "тел.|Тел.:|телефон|телефон:|моб.|мобильный|по номеру|по телефону|номер|звонить:|звоните|позвоните|звонить по|связь:|факс",
    },
    "id_number": {
        "en": "passport|passport no.|passport number|Passport:|SSN|social security number|NI number|National Insurance|insurance number|driving licence|driver's license|licence no.|licence|ID card|national ID|ID|identity card|tax number|tax ID|seaman's book|discharge book|discharge book no.|seafarer's book|crew book no.|certificate of identity",
        "de": "Reisepass|Pass Nr.|Personalausweis|Ausweis|Ausweisnummer|Führerschein|Steuer-ID|Steuernummer|Seefahrtsbuch|Versicherungsnummer",
        "es": "pasaporte|pasaporte n.º|DNI|NIE|NIF|carné|licencia|licencia de conducir|libreta marítima|número fiscal|seguridad social",
        "ru": "паспорт|паспорт:|паспорт №|серия и номер паспорта|ИНН|ИНН:|СНИЛС|удостоверение|удостоверение личности|удостоверение моряка|паспорт моряка|мореходная книжка|права|водительское удостоверение|документ|полис",
    },
    "address": {
        "en": "lives at|living at|resident at|address:|Address:|address is|deliver to|delivered to|goes to|ship to|send it to|send them back to|invoice to|bill to|moved to|office at|workshop at|home address:|Deliver to:\n|at|to",
        "de": "wohnhaft|wohnt in der|Adresse:|Anschrift:|liefern an|Lieferung an|Lieferadresse:|an|nach",
        "es": "domicilio:|domicilio|dirección:|vive en|enviar a|entregar en|envíe la pieza a|dirección de envío:|a",
        "ru": "адрес:|адрес|по адресу|по адресу:|проживает:|живёт:|живёт по адресу|прописка|прописан|зарегистрирован:|доставить:|доставка:|доставить сюда:|отправить сюда:|адрес доставки:|прислать на",
    },
}
AFTER = {
    "name": {
        "en": "wrote|said|says|reported|called|confirmed|agreed|signed|replied|asked|noted|will call|has left|took over|repaired it|found|lives at|from|and|,|.|;|:|(|, Second Engineer|, Service Manager|\nChief Engineer|\nService Manager|'s",
        "de": "hat|schreibt|meldet|bestätigt|sagte|unterschrieb|und|,|.|(|;|\nMeister",
        "es": "firmó|confirmó|dijo|llamó|escribió|presentó|y|,|.|(|;|\nJefe de máquinas",
        "ru": "подтвердил|подтвердила|сообщил|сообщила|написал|принял|приняла|подписал|просит|под роспись|и|,|.|;|(|\nСтарший механик",
    },
    "email": {"en": "for details|.|,|;|)|or|and|is closed|bounced", "de": ".|,|oder|;", "es": ".|,|o|;", "ru": ".|,|или|;|закрыта"},
    "phone": {"en": "before noon|after six|.|,|;|)|or|any time|) later|) after the watch", "de": ".|,|oder|;|ab acht Uhr", "es": ".|,|o|;", "ru": ".|,|или|;|после смены|до обеда"},
    "id_number": {"en": ".|,|;|, valid|was shown|attached|expired", "de": ".|,|;|vorgelegt|gültig", "es": ".|,|;|vigente", "ru": ".|,|;|, действителен|предъявлен|проверен"},
    "address": {"en": ".|,|;|, care of|for the attention of|. Thank you|by Friday", "de": ".|,|;|, Empfänger", "es": ".|,|;|, a nombre de", "ru": ".|,|;|, получатель|к пятнице"},
}
#: Cues that are kept for measurement.
HELD_CUES = {
    "name": {"en": "led by|relieved by|in the words of|my colleague|the surveyor", "de": "begleitet von", "es": "revisado por", "ru": "замечание внёс|со слов"},
    "email": {"en": "forward to|reply at", "de": "Antwort an", "es": "responder a", "ru": "ответ на"},
    "phone": {"en": "desk line|pager", "de": "Durchwahl", "es": "extensión", "ru": "дежурный"},
    "id_number": {"en": "travel document|residence permit", "de": "Aufenthaltstitel", "es": "cédula", "ru": "вид на жительство"},
    "address": {"en": "parcel to|registered at", "de": "Versand an", "es": "reside en", "ru": "груз на"},
}
KEYS = {
    "name": "name|fullname|Name|user|customer|ФИО|имя|nombre",
    "email": "mail|email|e-mail|Email|почта|correo",
    "phone": "phone|tel|mobile|Phone|тел|телефон|teléfono",
    "id_number": "id|doc|passport|ID|док|паспорт|документ",
    "address": "address|addr|street|адрес|dirección",
}

#: Plain words; a random share of them is replaced by made-up ones.
WORDS = {
    "en": _w(
        "the a this that of in on to for with from by at and or but not is was are were has had will can must after before until when while because under over near between check remove install clean replace loosen tighten measure inspect drain fill test run stop start "
        "wait note see use keep pump valve filter engine gasket shaft piston bearing cooler belt hose sensor plate cover tank line seal ring bolt nut housing pressure oil water fuel air gear coolant leak wear noise crack limit value order part kit box report letter page table step "
        "hour minute day week month watch shift deck yard harbour office desk gate parcel invoice quote batch drum label new old worn clean dry dirty tight loose left right upper lower slowly again twice always never soon today yesterday tomorrow Monday Friday March copy photo list notice please thank you we they it he she her his our your"
    ),
    "de": _w(
        "der die das den dem ein eine einen und oder aber nicht ist war wird wurde hat mit von zu bei nach vor für auf an aus im am bis wenn dann prüfen reinigen tauschen lösen messen Pumpe Ventil Filter Motor Dichtung Welle Kolben Lager Kühler Riemen Schlauch Fühler Deckel Tank Druck Öl Wasser Luft Wert Teil Blatt Seite Stunde Tag Woche heute morgen neu alt bitte Rechnung Lieferung Angebot"
    ),
    "es": _w(
        "el la los las un una y o pero no es era fue con de del para por en a al hasta cuando luego revise limpie cambie afloje mida bomba válvula filtro motor junta eje pistón cojinete enfriador correa manguera sensor tapa tanque presión aceite agua aire valor pieza hoja página hora día semana hoy mañana nuevo viejo favor factura pedido envío"
    ),
    "ru": _w(
        "и в на с по от до за из к у о не но или что как если когда после перед для при под над это был была было будет есть проверьте снимите установите очистите замените ослабьте измерьте слейте насос клапан фильтр двигатель прокладка вал поршень подшипник радиатор ремень шланг датчик крышка бак давление масло вода топливо воздух зазор предел значение деталь лист страница таблица "
        "шаг час минута день неделя вахта смена палуба цех порт склад коробка счёт заказ накладная новый старый изношен чистый сухой снова сегодня вчера завтра письмо копия фото замер течь шум пожалуйста спасибо мы они он она их ваш наш работы работу пропуск запчасти фильтры детали документы"
    ),
}
THINGS = {
    "en": _w("oil_pump fuel_filter cylinder_head water_pump crankshaft gasket connecting_rod valve_spring air_filter starter_motor thermostat_housing alternator_belt injector_nozzle oil_pan heat_exchanger piston_ring gear_cover pressure_sensor fuel_line exhaust_valve"),
    "de": _w("Ölpumpe Kraftstofffilter Zylinderkopf Wasserpumpe Kurbelwelle Dichtung Einspritzdüse Anlasser Ölwanne Luftfilter"),
    "es": _w("bomba_de_aceite filtro_de_combustible culata bomba_de_agua cigüeñal junta inyector arranque cárter filtro_de_aire"),
    "ru": _w("масляный_насос топливный_фильтр прокладку_головки водяной_насос клапан поршень коленчатый_вал датчик_давления ремень_генератора радиатор"),
}
SHIPS = _w("MV_{} MV_{}_{} MS_{}_{} tug_{} barge_{} ferry_{} dredger_{}_{} trawler_{} yacht_{}_{} the_{}")
FIRMS = _w("{}_Marine {}_Diesel_Service {}_Shipyard {}_Supply_Co {}_Power {}_Engine_Works {}_and_{}_Ltd {}_Yard {}_GmbH {}_Service {}_Dealers {}_Boats {}_Engines {}_Motors {}_Diesel {}_Logistics {}_Shipping {}_Lines {}_Group {}-{}_Inc {}_{}_Company {}_Systems {}_Tools")
TOOLS = _w("Allen_key Phillips_screwdriver Loctite_sealant Diesel_cycle Otto_cycle Venturi_tube Pitot_tube Hooke's_law Vickers_hardness Stillson_wrench ключ_Аллена цикл_Дизеля число_Рейнольдса закон_Гука Inbusschlüssel llave_Allen")
HEADS = _w("Inspect Replace Test Install Drain Clean Remove Adjust Specifications Check Lubricate Tighten Assemble Disconnect Calibration Removal Overview")
HELD = {
    "FIRST": _w("Gregory Helen Wolfgang Beatriz Sandeep Niamh Chiara Bogdan Simone"),
    "LAST": _w("Pemberton Hawthorne Zimmermann Navarro Lombardi Eriksson Wójcik Takahashi Abernathy Downing"),
    "FIRST_RU_M": _w("Григорий Станислав Юрий"),
    "FIRST_RU_F": _w("Марина Полина Вероника"),
    "LAST_RU": _w("Зимин Рябов Тарасов Ершов"),
    "FATHER_RU": _w("Юрьев Борисов"),
    "STREETS": _w("Juniper Abbey Foundry Riverside"),
    "TOWNS": _w("Swindon Tacoma Great_Yarmouth"),
    "STREETS_DE": _w("Mozart Wiesen Ufer"),
    "TOWNS_DE": _w("Kassel Lübeck"),
    "STREETS_ES": _w("Calle_del_Pez Avenida_de_la_Paz"),
    "TOWNS_ES": _w("Murcia Cádiz"),
    "STREETS_RU": _w("Чехова Озёрная Заводская"),
    "TOWNS_RU": _w("Пермь Калуга"),
    "HOSTS": _w("proton.me posteo.de boat.example list.ru"),
}
FITTED = {k: globals()[k] for k in HELD}
#: Cues after which a surname often stands alone.
POSTS = set(
    "Mr|Mr.|Mrs|Mrs.|Ms|Ms.|Dr.|Dr|Prof.|Captain|Capt.|Officer|Chief Engineer|Second Engineer|Engineer|Chief Mate|Foreman|Mechanic|Fitter|Bosun|Dear Mr|Dear Mrs|Dear Ms|Herr|Herrn|Frau|Kapitän|Ingenieur|Meister|Sehr geehrter Herr|Sehr geehrte Frau|"
    "señor|el señor|la señora|Sr.|Sra.|el capitán|el jefe|el técnico|el mecánico|ingeniero|Estimado señor|капитан|механик|старший механик|инженер|мастер|боцман|моторист|слесарь|господин|госпожа".split("|")
)
#: What follows some of the cues after a mention.
FOLLOWS = {"lives at": "address", "care of": "name", "for the attention of": "name", "Empfänger": "name", "a nombre de": "name", "получатель": "name"}

#: Published shapes of national and maritime documents: # a digit, A a Latin capital, Б a Russian one.
NUMBERS = _w("###-##-#### AA_##_##_##_A AA######A ######### AA####### A######## AAA###### AAAAA######AA#AA A####### AAA#######A## AAA#######A#AA A########## ########A ########A A######### ########### ##-####### AA###### A###### AA###-#### AAA-###### AA-####### ##########A ########_A AA#######")
NUMBERS_RU = _w("##_##_###### ####_###### ############ ########## ###-###-###_## ББ-####### ББ_####### ББ-###### №####### ##_№_#######")


class Maker:
    """Puts the texts together, the same way in every run; ``held`` takes the words that are never trained on."""

    def __init__(self, seed: int = 11, held: bool = False):
        self.r = random.Random(seed)
        self.words = HELD if held else FITTED
        self.cues = {k: {lang: (HELD_CUES[k][lang] if held else BEFORE[k][lang]).split("|") for lang in BEFORE[k]} for k in KINDS}
        self.after = {k: {lang: v.split("|") for lang, v in AFTER[k].items()} for k in KINDS}

    # Parts

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def shaped(self, form: str) -> str:
        r = self.r
        return "".join(self.digits(1) if c == "#" else r.choice("ABCDEFGHJKLMNPQRSTWXYZ") if c == "A" else r.choice("АВЕКМНОРСТФЯ") if c == "Б" else c for c in form)

    def coined(self, russian: bool = False, most: int = 3) -> str:
        """A word of random syllables."""
        r = self.r
        c, v = ("бвгдзклмнпрстфхцчшж", "аеиоуыюя") if russian else ("b c d f g h j k l m n p r s t v w z br ch dr fl gr kr pl qu sch sh st th tr".split(), "a e i o u ee ai ou".split())
        close = ["", "", *("нрлмств" if russian else "n r l m s t ck ll nd rt".split())]
        return "".join(r.choice(c) + r.choice(v) + r.choice(close) for _ in range(r.randint(1, most)))

    def surname(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return r.choice(self.words["LAST"])
        w = self.coined().capitalize() + r.choice("n berg ski ton sen ro son a er ell ham ley ford o us ez ich moor by dal we".split())
        return w + (f"-{self.coined(most=2).capitalize()}" if r.random() < 0.05 else "")

    def cased(self, s: str) -> str:
        x = self.r.random()
        return s.upper() if x < 0.08 else s.lower() if x < 0.13 else s

    def name(self, alone: bool = False) -> str:
        r = self.r
        first = r.choice(self.words["FIRST"]) if r.random() < 0.25 else self.coined(most=2).capitalize() + r.choice(["", "a", "o", "n", "e"])
        last, i = self.surname(), r.choice("ABCDEFGHJKLMNPRSTV")
        if alone:
            return self.cased(last)
        return self.cased(r.choice([f"{first} {last}"] * 5 + [f"{first} {i}. {last}", f"{i}. {last}", f"{last.upper()}, {first}", f"{last}, {first}", f"{last} {first}", last]))

    def name_ru(self, dative: bool = False, alone: bool = False) -> str:
        r = self.r
        woman = r.random() < 0.45
        last = r.choice(self.words["LAST_RU"]) if r.random() < 0.15 else self.coined(True).capitalize() + r.choice("ин ов ев ков нов яков енков цев".split())
        first = r.choice(self.words["FIRST_RU_F" if woman else "FIRST_RU_M"])
        if r.random() < 0.6:
            first = self.coined(True, 2).capitalize() + ("а" if woman else r.choice("нртмлв"))
        father = (r.choice(self.words["FATHER_RU"]) if r.random() < 0.6 else self.coined(True, 2).capitalize() + r.choice(["ов", "ев"])) + ("на" if woman else "ич")
        if woman:
            last += r.choice(["ой", "у"]) if dative else "а"
            first, father = (first[:-1] + "е", father[:-1] + "е") if dative else (first, father)
        elif dative:
            last += r.choice(["у", "а", "ым"])
            first = first[:-1] + "ю" if first[-1] == "й" else first + "у"
            father += "у"
        if alone:
            return self.cased(last)
        i, j = r.choice("АБВГДЕЗИКЛМНПРСТФЮЯ"), r.choice("АБВГДЕИКЛМНПС")
        return self.cased(r.choice([f"{first} {last}", f"{last} {first}", f"{last} {i}. {j}.", f"{last} {i}.{j}.", f"{i}. {j}. {last}", f"{i}.{j}. {last}", f"{i}. {last}", f"{last} {first} {father}", f"{first} {father}", f"{last.upper()} {first}", last]))

    def email(self) -> str:
        r = self.r
        first = (r.choice(self.words["FIRST"]) if r.random() < 0.5 else self.coined(most=2)).lower()
        last = self.surname().lower().replace("-", "").replace(" ", "").replace("'", "")
        user = r.choice([f"{first}.{last}", f"{first}-{last}", f"{first[0]}{last}", f"{last}{self.digits(r.randint(1, 4))}", f"{last}_{first[0]}{self.digits(2)}", f"{last}+{self.coined().lower()}", f"{first}_{last}", first, last, f"{first[0]}.{last}"])
        deep = r.choice(["", "", f".{self.coined(most=2)}", f"-{self.coined(most=2)}"])
        host = r.choice(self.words["HOSTS"]) if r.random() < 0.3 else f"{self.coined()}{deep}.{r.choice('com net org de ru es co.uk example test invalid'.split())}"
        x = r.random()
        if x < 0.55:
            s = f"{user}@{host}"
        elif x < 0.7:
            a, b, c = r.choice([("(", ")", " "), ("[", "]", " "), ("(", ")", ""), ("[", "]", "")])
            s = f"{user}{c}{a}at{b}{c}{host.replace('.', f'{c}{a}dot{b}{c}') if r.random() < 0.6 else host}"
        elif x < 0.8:
            s = f"{user} @ {host}"
        elif x < 0.9:
            s = f"{user} at {host.replace('.', ' dot ')}"
        else:
            s = f"{user}@ {host}" if r.random() < 0.3 else f"{user.replace('.', ' . ')} @ {host.replace('.', ' . ')}" if r.random() < 0.4 else f"{user}@{host}"
        return s.upper() if r.random() < 0.06 else s

    def phone(self, russian: bool = False) -> str:
        """A national code, an area and groups, parted in one of the usual ways."""
        r = self.r
        if russian or r.random() < 0.1:
            lead = r.choice(["+7", "8", "+7", "8"])
            area, rest = self.digits(3), r.choice(["###-##-##", "### ## ##", "###-####", "#######", "### ####", "###-##-##"])
            sep = r.choice([" ", "-", ""])
            s = r.choice([f"{lead}{sep}({area}){sep}{rest}", f"{lead}{sep}{area}{sep}{rest}", f"{lead} {area} {rest}"])
            return self.shaped(s)
        sep = r.choice([" ", " ", "-", ".", " "])
        groups = r.choice(["### ####", "### ####", "######", "### ###", "#### ####", "##### ###", "## ## ##", "#### ###", "## ## ## ##", "##### ####", "#### ####"]).replace(" ", sep)
        area = self.digits(r.choice([2, 3, 3, 3, 4, 5]))
        if r.random() < 0.45:
            cc = "+" + r.choice("1 1 20 27 30 31 33 34 39 41 44 44 45 46 47 48 49 61 65 81 86 90 91 353 358 380".split())
            s = r.choice([f"{cc} {area}{sep}{groups}", f"{cc}{sep}{area}{sep}{groups}", f"{cc} ({area}) {groups}", f"{cc}{area}{groups.replace(sep, '')}"])
        elif r.random() < 0.5:
            s = r.choice([f"({area}) ###-####", f"({area}) {groups}", "###-###-####", "###.###.####", "### ### ####", f"({area})#######"])
        else:
            s = r.choice(["0### ######", "0#### ######", "0#### ### ###", "0## ########", "0##/#######", "0#### ###-##", "0##########", f"0{area} {groups}"])
        return self.shaped(s)

    def number(self, russian: bool = False) -> str:
        r = self.r
        if r.random() < 0.25:  # an unpublished mixture of groups
            form = "".join(r.choice(["A", "#", "#", "##", "###", "####"]) for _ in range(r.randint(3, 5)))
            if sum(c == "#" for c in form) >= 6:
                return self.shaped(form)
        return self.shaped(r.choice(NUMBERS_RU if russian else NUMBERS))

    def address(self, lang: str) -> str:
        r, w = self.r, self.words
        n, flat = r.randint(1, 230), r.randint(1, 60)
        if lang == "de":
            street = r.choice(w["STREETS_DE"]) if r.random() < 0.3 else self.coined().capitalize()
            way = r.choice(WAYS_DE) if r.random() < 0.8 else " " + r.choice(["Straße", "Weg", "Allee", "Platz"])
            tail = r.choice(["", f", {self.digits(5)} {self.town('TOWNS_DE')}", f", {self.digits(5)} {self.town('TOWNS_DE')}"])
            return self.cased(f"{street}{way} {n}{r.choice(['', '', 'a', 'b'])}{tail}")
        if lang == "es":
            street = r.choice(w["STREETS_ES"]) if r.random() < 0.3 else f"{r.choice(['Calle', 'Avenida', 'Paseo', 'Plaza', 'Calle del', 'Calle de la', 'Avenida de las', 'C/'])} {self.coined().capitalize()}"
            tail = r.choice(["", f", {self.digits(5)} {self.town('TOWNS_ES')}", f", {self.digits(5)} {self.town('TOWNS_ES')}", f", {flat}.º, {self.digits(5)} {self.town('TOWNS_ES')}"])
            return self.cased(f"{street}, {n}{tail}")
        if lang == "ru":
            street = r.choice(w["STREETS_RU"]) if r.random() < 0.2 else self.coined(True).capitalize() + r.choice(["ская", "ная", "ов", "ина", "ева", "ская слобода"])
            town, code = self.town("TOWNS_RU"), self.digits(6)
            forms = [
                f"ул. {street}, д. {n}, кв. {flat}", f"г. {town}, ул. {street}, {n}", f"{code}, г. {town}, {street} пер., {n}", f"{street} ул., дом {n}, {town}", f"{code}, {town}, ул. {street}, дом {n}, кв. {flat}",
                f"г. {town}, пр. {street}, д. {n}", f"пер. {street}, {n}-{flat}", f"{street} ул., д. {n}", f"г. {town}, {street} пер., {n}, кв. {flat}", f"ул. {street}, {n}, {town}", f"просп. {street}, дом {n}",
            ]
            return self.cased(r.choice(forms))
        street = f"{n}{r.choice(['', '', '', 'A', 'B', 'C'])} {r.choice(w['STREETS']) if r.random() < 0.2 else self.coined().capitalize() + r.choice(['', '', ' ' + self.coined(most=2).capitalize()])} {r.choice(WAYS)}"
        town = self.town("TOWNS")
        code = r.choice([self.digits(5), self.shaped("AA# #AA"), self.shaped("A## #AA"), self.shaped("AA## #AA"), f"{self.shaped('AA')} {self.digits(5)}"])
        inner = r.choice([f"Flat {flat}", f"Apt {flat}", f"Suite {flat}", f"Unit {flat}", f"Apt. {flat}"])
        forms = [street, street, f"{street}, {town}", f"{inner}, {street}, {town}", f"{street}, {inner}, {town} {code}", f"{street}, {town} {code}", f"{street}, {town}, {code}", f"{inner}, {street}, {town}, {code}", f"{inner}, {street}"]
        return self.cased(r.choice(forms))

    def town(self, of: str) -> str:
        r = self.r
        if r.random() < 0.25:
            return r.choice(self.words[of])
        ru = of == "TOWNS_RU"
        w = self.coined(ru).capitalize() + (r.choice(["ск", "град", "ов", "ино"]) if ru else r.choice(["", "ton", "ford", "mouth", "heim", "ville", "haven"]))
        if ru or r.random() < 0.55:
            return w
        return r.choice([f"Port {w}", f"{w} Bay", f"East {w} Quay", f"Lower {w}", f"St. {w}", f"{w} Point", f"New {w}", f"{w} Bridge", f"Kil{w.lower()} {self.coined(most=2).capitalize()}"])

    def mention(self, kind: str, lang: str, alone: float = 0.1) -> str:
        r = self.r
        if kind == "name":
            alone = r.random() < alone
            return self.name_ru(r.random() < 0.35, alone) if lang == "ru" else self.name(alone)
        if kind == "email":
            return self.email()
        if kind == "phone":
            return self.phone(lang == "ru" and r.random() < 0.7)
        if kind == "id_number":
            return self.number(lang == "ru" and r.random() < 0.8)
        return self.address(lang)

    # Words without a mention

    def value(self) -> str:
        r = self.r
        x = r.choice([self.digits(2), self.digits(3), f"{self.digits(2)}.{self.digits(1)}", f"{self.digits(1)},{self.digits(1)}", "1" + self.digits(3)])
        u = r.choice("kPa bar rpm mm L kW Hz mV N·m °C psi ppm кПа бар мм л кВт Н·м об/мин".split())
        return f"{x}{r.choice([' ', ' ', ''])}{u}" + (f" ({self.digits(2)} psi)" if r.random() < 0.15 else "")

    def code(self) -> str:
        """A part, order, serial or seal number, a date, a version or a count, with or without the word that names it."""
        r = self.r
        if r.random() < 0.3:
            return self.shaped(r.choice(["###-####", "#A-####"]))
        form = r.choice("####-###-### ###-#### #A-#### ######## PO-##### ###/#### ##.#####-#### A####-## AAA##### #AA##### AA###### A####### AA-#### ##########  ####-##-## ##.##.#### ##.#.##.## 192.168.#.## #### ## ###.## g######## ББ-#### ####_####_#### ##_##_## #### ##:##".split())
        word = r.choice(["", "", "", "order ", "part ", "drum no. ", "kit ", "batch ", "S/N ", "serial number ", "engine ", "panel ", "version ", "unit ", "see page ", "table ", "заказ ", "деталь ", "№ ", "двигатель ", "партия ", "накладная ", "пломба ", "Teil ", "Bestellung ", "pieza ", "pedido ", "модель ", "model "])
        return word + self.shaped(form.replace("_", " "))

    def proper(self, lang: str) -> str:
        """A ship, a firm, a tool or a heading: capitals that are no person's."""
        r = self.r
        x = r.random()
        if x < 0.8:
            form = r.choice(SHIPS if x < 0.4 else FIRMS)
            common = [w for w in WORDS["en"] if len(w) > 3]
            s = form.format(*[(self.coined() if r.random() < 0.6 else r.choice(common)).capitalize() for _ in range(2)])
            if r.random() < 0.35:
                s = r.choice(["Экипаж ", "экипаж ", "судно ", "фирма ", "на борту "] if lang == "ru" else ["Crew of ", "the crew of ", "crew of the ", "aboard ", "the firm ", "owners of "]) + s
            if r.random() < 0.5:
                s += " " + r.choice([c for c in AFTER["name"][lang].split("|") if c[0].isalpha() and c not in FOLLOWS])
            return s
        if x < 0.9:
            made = self.coined(lang == "ru").capitalize()
            return f"{r.choice(['ключ', 'шкала', 'трубка', 'закон', 'муфта'])} {made}{r.choice(['а', 'а', 'ера'])}" if lang == "ru" else f"{r.choice(['the ', 'a ', 'one ', ''])}{made} {r.choice(['gauge', 'key', 'tube', 'wrench', 'clamp', 'screw', 'scale', 'test', 'valve'])}"
        return r.choice(TOOLS)

    def plain(self, lang: str, n: int) -> str:
        """A run of words without a mention."""
        r = self.r
        out = []
        made = r.choice([0.0, 0.1, 0.5])
        while len(out) < n:
            x = r.random()
            if x < 0.06:
                out.append(self.value())
            elif x < 0.11:
                out.append(self.code())
            elif x < 0.16:
                out.append(self.proper(lang))
            elif x < 0.26:
                out.append(r.choice(THINGS[lang]))
            else:
                w = r.choice(WORDS[lang])
                if len(w) > 3 and r.random() < made:
                    w = self.coined(lang == "ru")
                    w = w.capitalize() if lang == "de" and r.random() < 0.4 else w
                out.append(w)
            if r.random() < 0.06:
                out[-1] += r.choice([",", ",", ";", ":", " -"])
        return " ".join(out)

    def sentence(self, lang: str) -> Pieces:
        """A sentence, heading, table row or list item without a mention."""
        r = self.r
        x = r.random()
        if x < 0.18:
            words = (r.choice(THINGS["en"]) if r.random() < 0.3 else " ".join(self.coined() if r.random() < 0.5 else r.choice(WORDS["en"]) for _ in range(r.randint(1, 3)))).title()
            return [(f"{words} - {r.choice(HEADS)}" if r.random() < 0.5 else f"{r.choice(HEADS)} {words}", None)]
        if x < 0.28:
            cells = [r.choice([self.value, self.code, lambda: r.choice(THINGS[lang]), lambda: str(r.randint(1, 99))])() for _ in range(r.randint(3, 5))]
            return [(r.choice([" | ", " | ", ";", "\t"]).join(cells), None)]
        s = self.plain(lang, r.randint(4, 14))
        if r.random() < 0.2:
            s = f"{self.proper(lang)} {s}"
        s = s[0].upper() + s[1:]
        if r.random() < 0.15:
            s = f"{r.randint(1, 30)}. " + s
        return [(s + r.choice([".", ".", ".", ".", "", ":", "!"]), None)]

    # Sentences with mentions

    def cue(self, kind: str, lang: str) -> Pieces:
        """A mention between two cues, at times without the first or the second."""
        r = self.r
        before, after = r.choice(self.cues[kind][lang]), r.choice(self.after[kind][lang])
        if kind == "name" and r.random() < 0.25:
            before = r.choice([c for c in self.cues[kind][lang] if c in POSTS] or [before])
        out: Pieces = []
        if before:
            out.append((before + ("" if before[-1] in "\n(" else " "), None))
        out.append((self.mention(kind, lang, 0.65 if before in POSTS else 0.1), kind))
        follows = FOLLOWS.get(after.strip(" ,"))
        if follows:
            return out + [((after if after[0] == "," else " " + after) + " ", None), (self.mention(follows, lang), follows), (r.choice([".", ".", ",", ";", ""]), None)]
        if before.endswith("("):
            after = ")" if after[0] != ")" else after
        if after == "(":
            other = r.choice(["email", "phone", "id_number"])
            cue = r.choice(["", r.choice(self.cues[other][lang]) + " "]) if other != "id_number" else r.choice(self.cues[other][lang]) + " "
            return out + [(" (" + cue.replace("(", ""), None), (self.mention(other, lang), other), (")", None)]
        if after == "'s" or after[0] in ".,;:)\n":
            return out + [(after, None)]
        return out + [(" " + after, None)]

    def told(self, lang: str) -> Pieces:
        """A sentence with one to three mentions."""
        r = self.r
        kinds = [r.choices(KINDS, (5, 2, 2, 2, 2))[0]]
        while len(kinds) < 3 and r.random() < 0.4:
            kinds.append(r.choice(KINDS))
        out: Pieces = []
        if kinds[0] == "name" and r.random() < 0.2:
            # The name is the subject at the beginning of the sentence.
            after = r.choice([c for c in self.after["name"][lang] if c[0].isalpha()] + [r.choice(WORDS[lang])])
            between = r.random()
            out.append((self.mention("name", lang, 0.1), "name"))
            if between < 0.4:
                other = r.choice(["email", "phone"])
                out += [(" (", None), (self.mention(other, lang), other), (")", None)]
            return out + [(f" {after} {self.plain(lang, r.randint(2, 8))}", None), (r.choice([".", ".", ""]), None)]
        if r.random() < 0.7:
            lead = self.plain(lang, r.randint(1, 5))
            out.append((lead[0].upper() + lead[1:] + r.choice([" ", " ", " ", ", ", ": "]), None))
        for i, k in enumerate(kinds):
            if i and out[-1][1] is None and out[-1][0][-1:] not in "\n":
                out.append((" " if r.random() < 0.7 else f" {self.plain(lang, r.randint(1, 3))} ", None))
            out += self.cue(k, lang)
        end = out[-1][0][-1:]
        if end not in ".\n" and r.random() < 0.7:
            out.append((" " + self.plain(lang, r.randint(1, 6)), None))
            out.append((r.choice([".", ".", "", ";"]), None))
        return out

    def record(self, lang: str) -> Pieces:
        """Fields one after another, with or without their keys."""
        r = self.r
        kinds = r.sample(KINDS, r.randint(2, 4))
        if "name" not in kinds:
            kinds[0] = "name"
        sep = r.choice([";", "; ", " | ", "|", ", ", "\t", "\n"])
        key = r.choice(["", "", "=", ": "])
        out: Pieces = []
        if not key and r.random() < 0.6:
            kinds = ["name", *[k for k in kinds if k != "name"]]
            head = r.choice(["Contact", "Customer", "Owner", "Crew", "Person", "Контакт", "Клиент", "Kontakt", "Contacto", "ID"])
            out.append((head + (sep if sep != "\n" else ": "), None))
        for i, k in enumerate(kinds):
            if i:
                out.append((sep, None))
            if key:
                out.append((r.choice(KEYS[k].split("|")) + key, None))
            elif k == "id_number" and r.random() < 0.7:
                out.append((r.choice(self.cues[k][lang]) + " ", None))
            elif k == "address" and r.random() < 0.4:
                out.append((r.choice(self.cues[k][lang]).rstrip("\n") + " ", None))
            out.append((self.mention(k, lang), k))
        return out + [(r.choice(["", ".", "\n"]), None)]

    def signature(self, lang: str) -> Pieces:
        """The end of a letter."""
        r = self.r
        start = [c for c in self.cues["name"][lang] if c.endswith("\n")] or ["\n"]
        out: Pieces = [(r.choice(start), None), (self.mention("name", lang), "name"), ("\n", None)]
        if r.random() < 0.5:
            out.append((r.choice(["Chief Engineer", "Service Manager", "Fleet Office", "Superintendent", "Leiter Technik", "Jefe de taller", "Старший механик", "Отдел снабжения"]) + "\n", None))
        if r.random() < 0.6:
            out += [(r.choice([c for c in self.cues["phone"][lang] if c[-1] in ".:" or len(c) < 8] or ["Tel."]) + " ", None), (self.mention("phone", lang), "phone"), ("\n", None)]
        if r.random() < 0.5:
            out += [(self.mention("email", lang), "email"), ("\n", None)]
        if r.random() < 0.3:
            out += [(self.mention("address", lang), "address"), ("\n", None)]
        return out

    def noisy(self, s: Pieces, share: float) -> Pieces:
        x = self.r.random()
        if x < share:
            return [(a.upper(), k) for a, k in s]
        if x < 1.6 * share:
            return [(a.lower().replace(",", "") if k is None else a, k) for a, k in s]
        if x < 2 * share:
            return [(a.replace(" ", "  "), k) for a, k in s]
        return s

    def text(self) -> Pieces:
        """A short text: a sentence with mentions or without, among others."""
        r = self.r
        lang = r.choices(("en", "ru", "de", "es"), (9, 6, 2, 2))[0]
        out: Pieces = []
        if r.random() < 0.6:
            out += self.noisy(self.sentence(lang), 0.12) + [(r.choice(["\n", "\n", " ", " ", "\n\n"]), None)]
        x = r.random()
        if x < 0.5:
            out += self.noisy(self.told(lang), 0.06)
        elif x < 0.62:
            out += self.noisy(self.record(lang), 0.04)
        elif x < 0.7:
            out += self.signature(lang)
        else:
            out += self.noisy(self.sentence(lang), 0.12)
        if r.random() < 0.5:
            out += [(r.choice(["\n", "\n", " ", " ", "\n\n"]), None)] + self.noisy(self.sentence(lang), 0.12)
        return [p for p in out if p[0]]


def examples(count: int = 14000, seed: int = 11, held: bool = False) -> list[Pieces]:
    """``count`` short texts as pieces ``(text, kind or None)``; ``held`` gives words and cues kept for measurement."""
    m = Maker(seed, held)
    return [m.text() for _ in range(count)]


def vocabulary() -> dict[str, list[str]]:
    """Names, streets, towns and hosts of the table, for the check against the test tables."""
    return {k: v for k, v in FITTED.items()}


def phrases() -> list[str]:
    """Cues and other fixed phrases of the table."""
    out = [p for table in (BEFORE, AFTER, HELD_CUES) for by in table.values() for v in by.values() for p in v.split("|")]
    return [re.sub(r"\s+", " ", p).strip() for p in out + TOOLS + SHIPS + FIRMS]
