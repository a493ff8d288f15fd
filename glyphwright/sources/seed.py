"""A built-in list of misspellings and of dialects, to start from: common English words, with the slips
that are made in them worked out by rule. Projects bring fuller lists as files."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..operators import dialect

#: Verbs that take s, ed and ing as they are; nouns that take s; words that stay.
_VERBS = """abandon absorb accept access account acknowledge address affirm afford alert allow alter amount annoy answer appear applaud appoint approach ascertain assault assert assess assign assist attach attack attempt attend attract avert
balloon behead bellow belong benefit bewilder blossom bombard boycott broaden burden cancel channel clarif collapse collect comfort command comment commission compel compensat complain concern conduct confess confirm conflict conform confront
connect consent consider consist construct consult consum contact contain contend content contest contract control convert convey convict correct correspond counter cover custom damag decay deduct defend deflect delay deliver demand depart depend
deploy design despair destroy detain detect deter develop deviat differ digest direct disagree disappear disappoint discard discount discover discuss disgust dismiss display disrespect distort disturb document earn embarrass embark embed employ
enact encounter endanger endow endur engender enjoy enlighten enlist enter entertain entrust establish exceed exclaim exhaust exhibit expand expect experiment explain exploit export express extend extract falter fashion fasten favor filter
finish flatten flourish follow foster frighten function further furnish gather govern guard happen harden harm harvest hasten highlight hinder honor impact implement import impress imprison incorporat indent infect inform inherit inhabit insert
insist inspect install instruct insult interact interest interpret interrupt invent invest jeopard journey kidnap launch lengthen lessen linger loosen maintain market matter measur mention merit mistreat mirror monitor moisten murmur neglect
number object obstruct offend offer operat oppress orchestrat overcom overlook partner pattern perfect perform permit persist plunder ponder possess predict present preserv prevent process proclaim profess profit prohibit project prolong
prospect protect protest publish punish purchas pursu question quicken ransom react reason rebuild recall reckon record recover redirect reflect refresh refund regard register regress reinforc reject relax relay remain remark remember remind
render repair repeat replay report represent request research resemble respect respond restor restrain restrict restructur result retain return review reward sanction scatter season select shelter shorten signal slacken slaughter soften
sponsor squander stagger strengthen stretch stumbl subject submit succeed suffer suggest summon support surrender surround suspect sustain swallow target temper threaten thunder toughen traffic transfer transform transmit transplant travel
treasur tremble trigger triumph uncover undergo understand unfold unlock utter vanish venture veto visit volunteer wander warrant weaken weather whisper whiten widen wither witness wonder worsen"""
#: Those of the verbs above that take other endings than these, or lack their last letter.
_CUT = frozenset("clarif compensat consum control damag deter deviat embed endur incorporat jeopard measur operat orchestrat overcom permit preserv purchas pursu rebuild reinforc restor restructur stumbl submit transfer transmit treasur undergo understand".split())
_NOUNS = """absence accident accommodation achievement acquaintance acquisition adjustment administration administrator advantage adventure advertisement agreement algorithm alignment allocation allowance alternative ambassador ambulance amendment
analysis announcement anniversary apartment apology apparatus appearance application appointment appreciation architecture argument arrangement article assertion assessment assignment assistance assistant association assumption atmosphere
attachment attendance attention attitude attribute audience authentication authorization availability background balance battery beginning behavior belief biography boundary breakfast building bulletin business calculation calendar campaign
candidate capability capacity captain category celebration certificate challenge champion character characteristic chemical chocolate circumstance citizen civilization classification collaboration colleague collection combination commander
commercial commitment committee communication community companion comparison compatibility competition complaint completion complexity component computer concentration conclusion condition conference configuration confirmation confusion
connection consequence consideration constraint construction consumer container continuation contribution controller convenience convention conversation conversion cooperation coordinate correction correspondence cousin creation creature
criterion criticism curiosity currency customer database deadline decision declaration decoration definition delegation delivery department dependency deployment description designer destination destruction detection development device
dictionary difference difficulty dimension dinosaur diplomat direction directory disadvantage disappointment disaster discipline discovery discrepancy discussion distance distribution division documentation economy education efficiency
election element elevator emergency emphasis employee employer encouragement encyclopedia engineer enterprise entertainment enthusiasm entrance environment equipment equivalent establishment estimate evaluation evidence evolution examination
example exception excitement execution exercise exhibition existence expectation expedition experience experiment explanation expression extension facility failure favorite feature festival fluctuation foreigner foundation fragment framework
frequency friendship function furniture generation government grammar guarantee guidance guideline hardware headquarters heritage hierarchy highway hospital household hypothesis identification identifier illustration imagination
implementation implication importance impression improvement incident inclusion independence indication individual industry influence information infrastructure initiative innovation inquiry inspection inspiration installation instance
institution instruction instructor instrument insurance integration intelligence intention interaction interface interference interpretation interruption interval intervention interview introduction invention investigation investment
invitation iteration journal judgment justification keyboard knowledge laboratory landscape language latitude leadership legislation liability library license lieutenant limitation literature location longitude machine magazine maintenance
majority management manager manufacturer material mathematics maximum meaning measurement mechanism medicine membership message microphone millennium minimum minister minority miracle miscellany mission mistake moderation modification
moment mountain movement multiplication museum mystery narrative nationality necessity negotiation neighbor neighborhood network newspaper nomination notification nuisance objective obligation observation occasion occupation occurrence
opening operation operator opinion opponent opportunity opposition optimization orchestra organization orientation original package paragraph parameter parliament participant partition passenger pattern performance permission personality
personnel perspective phenomenon philosophy photograph physician platform pleasure politician population portfolio portrait position possession possibility potential precedence prediction preference prejudice preparation presence presentation
president pressure principle priority privilege probability procedure profession professor programmer progress projection promotion pronunciation property proportion proposal protection protocol province psychology publication publisher
quality quantity quarter questionnaire reaction reality receipt reception recognition recommendation recording reduction reference reflection registration regulation relation relationship relative relevance religion replacement replication
representation representative reputation requirement reservation residence resistance resolution resource response responsibility restaurant restriction revolution satisfaction schedule scholarship scientist secretary security selection
sentence separation sequence session settlement shoulder signature significance similarity simulation situation software solution specification spectrum stability standard statement statistic strategy strength structure subscription
substance substitute success suggestion supervisor supplement surface surgeon surprise survey suspicion symptom synchronization telephone television temperature temptation tendency territory threshold tolerance tomorrow tournament tradition
traffic transaction transition translation transmission transparency transportation treatment triangle tutorial umbrella uncertainty understanding union universe university utility vacation validation variable variation vegetable vehicle
vengeance verification version village violation violence visibility vocabulary volunteer warehouse warranty weakness weather wilderness withdrawal workshop yesterday"""
_WORDS = """abbreviated absolutely abundant accidentally accordingly accurate accurately achieve achieved achieving acquire acquired actually additional additionally adequate adjacent advanced aggressive although altogether amateur ambiguous analogous
ancient annually anonymous another anybody anything apparent apparently appropriate approximate approximately arbitrary artificial asynchronous athletic automatic automatically available awkward basically beautiful because beginner believe
believed beneath between bizarre brilliant broccoli carefully category cemetery certainly changeable cheerful clearly commercial commonly comparable comparatively compatible competent complementary complete completed completely comprehensive
compulsory conceivable concurrent conscience conscientious conscious consecutive consequently considerable consistent consistently constantly contemporary continuous continuously controversial convenient conventional corresponding courageous
critical curious currently dangerous deceive decide decided deferred definite definitely deliberate deliberately delicious democratic dependent deprecated desirable desperate desperately determine determined different difficult
diligent disastrous discrete distinct domestic dominant duplicate during eighth electronic eligible eliminate embarrassed emotional enormous entirely environmental equally equivalent especially essential essentially eventually everybody
everything exactly exaggerate excellent exceptional excessive exclusive exclusively executable exhilarating existent existing expensive explicit explicitly extraordinary extreme extremely fahrenheit familiar famous fascinating february fictional
fiery finally financial foreign formerly forty forward frequently fulfilled fundamental furthermore generally generous genuine genuinely global gorgeous gradual gradually grateful guaranteed happily harass height hereditary horizontal however
humorous hundred hygiene hypocrisy identical identified ignorance illegal imaginary immediate immediately important impossible inadvertent inadvertently incidentally incompatible incorrect increase increasing incredible incredibly indefinite
independent independently indispensable individually inevitable inevitably infinite initial initialize initialized initially innocent instantaneous intelligent intentionally interesting intermediate internal international interoperable
irrelevant irresistible jealous knowledgeable laborious legitimate leisure liaison lightning literally loneliness luxurious magnificent mandatory manually marriage marvelous maximize meanwhile mechanical medieval mediocre metropolitan
miniature minimize minuscule mischievous miscellaneous misspell misspelled modified moreover mutually mysterious naturally necessarily necessary negative neither neutral nevertheless nineteen ninety normally noticeable notorious nuclear numerous
obedient obsolete obvious obviously occasional occasionally occurred occurring official officially omitted operational opposite optimistic ordinary organized original originally otherwise outrageous overall parallel partial partially
particular particularly pastime patience peaceful perceive perceived permanent permanently permissible perpendicular perseverance persistent personal personally persuade pharaoh physical physically piece playwright possible possibly
practical practically practice precede precious precise precisely predecessor preferred preliminary previous previously primarily primary principal prisoner private probably proceed professional prominent pronounce properly prosperous
provide provided psychological publicly purpose quantitative quarantine query quickly quiet readable realistic really reasonable receive received receiver receiving recent recently recognize recognized recommend recommended recurring redundant
referred referring regardless regular regularly relevant reliable religious reluctant remarkable remembrance reminiscent repetition repository resilient respectively restaurant resurrection retrieve retrieved rhythm ridiculous sacrifice
sacrilegious safety sandwich satellite scarcely scissors seize semantic separate separated separately separating separator sergeant serious several severely significant significantly similar similarly simultaneous simultaneously sincerely
skeptical something sometimes somewhere sophisticated specific specifically specified spontaneous stationary stationery straight strictly strongly stubborn subsequent subsequently substantial subtle successful successfully successive succinct
sufficient sufficiently superintendent supersede supposed supposedly surely surprising surveillance susceptible suspicious symmetric synchronous syntax systematic technical technically technique temporarily temporary terrible theoretical
thereafter therefore thorough thoroughly thousand through throughout together tomorrow tongue totally traditional tragedy tremendous truly twelfth typical typically tyranny ubiquitous ultimately unanimous unavailable unconscious
unconditionally undefined underlying undoubtedly unequivocally unfortunate unfortunately uniform unique universal unknown unlikely unnecessary unsigned until unusual usually utilize vacuum valuable variety various vertical vicious virtual
virtually visible voluntary vulnerable weird whatever wherever whether whichever wholly willful without worldwide writing"""
#: Words that some slip in one of the above would make, and that are right.
_RIGHT = frozenset("""adviser affects alteration bellows borders bowler comforts complimentary compliment complimented county counties counters course covert cresting defer deferred dependant desert discreet effects ensure ensurance except
excerpt excise exercising expand expend expends expended expending fiends fragrance garden gardener gather genus guarding humor illusion imminent insertion instance insurance lighting lightening missed moral morale necessity opposite oppose
parson personal personnel planed planing prescribe prescription proceeds prospective quite realty reference renders respectful retains staring statue statues stature statures story stories striped tempter tented thorough though trail trough
trials united untied warrants weather weathers whether wither withers wonders wanders wondering wandering wandered wondered witnesses contact contacts contract contracts contrast comments commends commands command commend commended
commanded commanding commending content contents contend contends assert assess asserts insert inserts affirm reflect reject rejects project detect detects deter deters direct digest assent ascent ascend consist insist resist persist desist
conform confirm confirms conforms confirmed conformed confirming conforming confirmation conformation invent intent invest infest infested infect inject object subject defect deflect inflect reacts relay really remark embark imported
transfer deport report deports reports deported reported deporting reporting import impart imparts imparted imparting depart departs departed departing retain retrain retrains restrain restrains restrained retrained detain obtain attain
contain maintain sustain prevision provision preposition proposition persecute prosecute perspective precede proceed proscribe accede exceed access excess recover recovers discover discovered uncover allusion allowed aloud aloft
sever severely signet singe lose loose loosen lessen lesson lessons hinder hander gander gender ponder pander panders pandered pandering pounder plunder blunder thunder wander winder wonder sander sunder render tender""".split())  # fmt: skip
_CLASSICS = {
    "teh": ["the"], "hte": ["the"], "adn": ["and"], "nad": ["and"], "taht": ["that"], "thsi": ["this"], "wiht": ["with"], "recieve": ["receive"], "recieved": ["received"], "beleive": ["believe"], "wierd": ["weird"], "freind": ["friend"],
    "thier": ["their"], "untill": ["until"], "wich": ["which"], "alot": ["a lot"], "occured": ["occurred"], "occuring": ["occurring"], "refered": ["referred"], "begining": ["beginning"], "seperate": ["separate"], "definately": ["definitely"],
    "accomodate": ["accommodate"], "goverment": ["government"], "neccessary": ["necessary"], "agressive": ["aggressive"], "publically": ["publicly"], "tommorow": ["tomorrow"], "wether": ["weather", "whether"],
}
_VOWELS, _DOUBLED = "aeiou", "cflmnprst"
#: Letters of a word in which slips are worked out.
LEAST = 7


@cache
def words() -> tuple[str, ...]:
    """The right words, in order."""
    out = set(_WORDS.split())
    for v in _VERBS.split():
        if v not in _CUT:
            out |= {v, v + "ing", v + ("d" if v.endswith("e") else "ed")} if not v.endswith("e") else {v, v + "d", v[:-1] + "ing"}
    for n in _NOUNS.split():
        out |= {n} if n.endswith(("s", "y")) else {n, n + "s"}
    return tuple(sorted(w for w in out if len(w) >= LEAST))


def slips(word: str) -> set[str]:
    """A word with two neighbours swapped, a letter left out or doubled, or another vowel; the first and
    last letters stay."""
    n = len(word)
    swapped = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(1, n - 2) if word[i] != word[i + 1]}
    missing = {word[:i] + word[i + 1 :] for i in range(1, n - 1) if word[i] not in (word[i - 1], word[i + 1])}
    doubled = {word[:i] + word[i] + word[i:] for i in range(1, n - 1) if word[i] in _DOUBLED and word[i] not in (word[i - 1], word[i + 1])}
    other = {word[:i] + v + word[i + 1 :] for i in range(1, n - 1) if word[i] in _VOWELS for v in _VOWELS if v != word[i]}
    return swapped | missing | doubled | other


@cache
def others() -> frozenset[str]:
    """Words besides :func:`words` that are right, all that some dialect has among them."""
    return _RIGHT | {w for line in clusters().splitlines() for w in re.findall(r": (\w+)", line)}


@cache
def dictionary() -> dict[str, list[str]]:
    """misspelling: corrections in order. Right words are never in it."""
    right = {*words(), *others()}
    out: dict[str, list[str]] = {}
    for word in words():
        for slip in slips(word):
            if slip not in right:
                out.setdefault(slip, []).append(word)
    return {k: sorted(v) for k, v in out.items()} | _CLASSICS


_OUR = "arbor ardor armor behavior candor clamor color demeanor endeavor favor fervor flavor glamor harbor honor humor labor neighbor odor parlor rancor rigor rumor savior savor splendor succor tumor valor vapor vigor".split()
_RE = "caliber center fiber liter luster meager miter ocher reconnoiter saber scepter sepulcher somber specter theater".split()
_IZE = """agonize apologize authorize capitalize categorize centralize characterize civilize colonize criticize customize economize emphasize equalize familiarize fertilize finalize formalize generalize harmonize initialize itemize legalize
localize maximize mechanize memorize minimize mobilize modernize nationalize neutralize normalize optimize organize oxidize parameterize patronize penalize personalize polarize popularize prioritize randomize realize recognize reorganize
revitalize serialize specialize stabilize standardize sterilize summarize symbolize sympathize synchronize synthesize tokenize utilize vaporize victimize visualize""".split()
_YZE = "analyze catalyze paralyze".split()
_L = "cancel channel counsel dial duel equal fuel funnel label level marvel model panel pedal quarrel rival signal snivel spiral total travel tunnel".split()
_PAIRS = "defense/defence offense/offence pretense/pretence gray/grey aluminum/aluminium jewelry/jewellery skeptical/sceptical skeptic/sceptic plow/plough mold/mould molt/moult smolder/smoulder pajamas/pyjamas mustache/moustache fulfill/fulfil enroll/enrol skillful/skilful willful/wilful maneuver/manoeuvre anesthetic/anaesthetic archeology/archaeology encyclopedia/encyclopaedia estrogen/oestrogen fetus/foetus hemoglobin/haemoglobin leukemia/leukaemia orthopedic/orthopaedic pediatric/paediatric catalog/catalogue analog/analogue artifact/artefact cozy/cosy sulfur/sulphur aging/ageing judgment/judgement acknowledgment/acknowledgement".split()


@cache
def clusters() -> str:
    """The dialects' table in the form that :func:`operators.dialect.parse` reads."""
    out = []

    def cluster(*rows):
        out.append("\n".join([f"# {rows[0].split(': ')[1].split(' ')[0]} <verified> (level 10)", *rows]))

    for w in _OUR:
        b = w[:-2] + "our"
        cluster(f"A: {w} / B: {b}", f"A: {w}s / B: {b}s", *([f"A: {w}ed / B: {b}ed", f"A: {w}ing / B: {b}ing"] if w in ("armor", "clamor", "color", "endeavor", "favor", "flavor", "harbor", "honor", "humor", "labor", "savor") else []))
    for w in _RE:
        cluster(f"A: {w} / B: {w[:-2]}re", *([f"A: {w}s / B: {w[:-2]}res"] if w not in ("meager", "somber") else []))
    for w in _IZE:
        for z, s in ((w, w[:-2] + "se"), (w + "s", w[:-2] + "ses"), (w + "d", w[:-2] + "sed"), (w[:-1] + "ing", w[:-2] + "sing")):
            cluster(f"A Z: {z} / Bv: {z} / B: {s}")
    for w in _YZE:
        cluster(f"A: {w} / B: {w[:-2]}se", f"A: {w}d / B: {w[:-2]}sed", f"A: {w[:-1]}ing / B: {w[:-2]}sing")
    for w in _L:
        cluster(f"A: {w}ed / B: {w}led", f"A: {w}ing / B: {w}ling")
    for pair in _PAIRS:
        a, b = pair.split("/")
        cluster(f"A: {a} / B: {b}")
    return "\n\n".join(out) + "\n"


def dialects(spark: SparkSession) -> DataFrame:
    """The compiled table of :func:`clusters`."""
    return dialect.compile(dialect.infer(dialect.parse(spark.createDataFrame([(clusters(),)], "value string"))))
